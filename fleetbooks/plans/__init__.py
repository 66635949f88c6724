"""Ready-made report bodies: the exports and the lists as the pages show them."""

from fleetbooks.plans import exports, labelled

__all__ = ["exports", "labelled"]
