"""The registered queries: rows of the SQL, columns of the contract, held-out rows."""

import zlib

import pytest

from checks.compare import _bag, connect
from fleetbooks.llm import queries

SF = "/root/testdata/sf0.001"

# What each query must return at least, with Spark's type names.
COLUMNS = {
    "op1_bytes": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op2_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_lines": "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_token_counts": "doc_id bigint, n_tokens bigint",
    "op6_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op8_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op9_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op10_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op11_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op13_urls": "page_id bigint, host string, path string, rule string, verdict string",
}
TABLE = {"op9_extraction": "pages", "op10_neighbours": "embeddings", "op13_urls": "pages"}


@pytest.fixture(scope="module")
def found(spark):
    """Each query's rows, worked out once."""
    known = {}

    def get(key):
        if key not in known:
            known[key] = queries.QUERIES[key](spark, SF)
            known[key] = (known[key], known[key].collect())
        return known[key]

    return get


def test_every_operator_has_one_query():
    assert set(queries.QUERIES) == set(COLUMNS)
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("key", list(COLUMNS))
def test_columns_and_whole_tables(spark, found, key):
    df, rows = found(key)
    want = [tuple(c.split(" ")) for c in COLUMNS[key].split(", ")]
    assert [x for x in df.dtypes if x in want] == want
    if key == "op11_collocations":
        # Rows of languages, not of documents.
        assert all(r["a"] >= 100 and 1 <= r["rank"] <= 2000 for r in rows)
        return
    ids = {r[0] for r in rows}
    table = spark.read.parquet(f"{SF}/{TABLE.get(key, 'documents')}.parquet")
    if key == "op10_neighbours":
        table = table.filter("vec_id % 100 = 0")
    assert ids == {r[0] for r in table.select(table.columns[0]).collect()}
    assert len(rows) == (10 if key == "op10_neighbours" else 1) * len(ids)


@pytest.mark.parametrize("key", list(queries.SQL))
def test_same_rows_as_the_sql(found, key):
    df, rows = found(key)
    cur = connect(SF).execute(queries.SQL[key])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert _bag(df.columns, [tuple(r) for r in rows]) == _bag(columns, cur.fetchall())


def test_collocations_of_a_table_that_has_some(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in queries.op11_collocations(spark, sf_dir).collect()]
    assert rows and sorted(rows) == sorted(connect(sf_dir).execute(queries.SQL["op11_collocations"]).fetchall())


def test_tampered_rows_do_not_verify(found):
    rows = found("op12_manifest")[1]
    hit = {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0}
    assert hit and {r["doc_id"] for r in rows if not r["verified"]} == hit
    assert len({r["root"] for r in rows}) == 1 and len({r["subroot"] for r in rows}) > 1


def _held(id):
    return zlib.crc32(str(id).encode()) % 4 == 2


def test_languages_of_held_out_rows(spark, found):
    langs = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect())
    rows = found("op2_language")[1]
    assert all(r["held_out"] == _held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(held) >= 0.95 * len(held)


def test_toxicity_of_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    marks = dict(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").collect())
    rows = queries.op4_toxicity(spark, sf_dir).collect()
    assert all(r["held_out"] == _held(r["doc_id"]) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["predicted"], marks[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    hits = sum(p and m for p, m in held)
    assert hits >= 0.85 * sum(m for _, m in held) and hits >= 0.9 * sum(p for p, _ in held)
