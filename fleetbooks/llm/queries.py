"""The registered queries: each operator on its whole table, results as digests."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetbooks.llm import (
    ann,
    bpe,
    bytededup,
    collocations,
    decontaminate,
    extract,
    langid,
    linededup,
    merkle,
    simhash,
    tokencount,
    toxicity,
    urlfilter,
)
from fleetbooks.llm.common import small_batches


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bytededup.without_repeats(_read(spark, sf_dir, "documents"))
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", "n_bytes", "n_removed", n_spans, F.sha2("kept", 256).alias("kept_sha256"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = langid.held_out("doc_id")
    model = langid.fit(docs.filter(~held))
    found = langid.identify(docs, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.without_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    found = toxicity.score(docs, toxicity.fit(docs, labels), tell=False)
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "score", "predicted")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokencount.load(public_tokenizers.path("piece_bpe_32k.model"))
    return tokencount.token_counts(_read(spark, sf_dir, "documents"), vocabulary)


def token_digest(docs: DataFrame, path: str) -> DataFrame:
    """Documents as token ids and back: count and hashes."""
    rows = bpe.encode(docs.select("doc_id", "text"), path, keep=False).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        "ids",
    )
    rows = bpe.decode(rows, path, keep=False)
    return rows.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tests = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, tests).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract(_read(spark, sf_dir, "pages"))
    return found.select("*", F.length("text").cast("long").alias("n_chars"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.filter(F.col("vec_id") % 100 == 0))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in merkle.FIELDS}
    # A wider number: one more than the largest long is a number too.
    fields["n_chars"] = F.col("n_chars").cast("decimal(20,0)") + 1
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    tampered = F.when(hit, F.unhex(merkle.leaf(list(fields.values()))))
    found = merkle.manifest(docs, carry={"tampered": tampered})
    others = F.filter("proof", lambda step: F.length(step) > 1)
    siblings = F.array_join(F.transform(others, lambda step: F.substring(step, 2, 64)), "")
    shown = F.coalesce(F.lower(F.hex("tampered")), "leaf")
    found = found.withColumn("folded_root", merkle.folded(shown, F.col("proof")))
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", verified
    )


# Host, beginning of the path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    found = urlfilter.judge(pages, urlfilter.fit(rules, pages))
    return found.select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bytes": op1_bytes,
    "op2_language": op2_language,
    "op3_lines": op3_lines,
    "op4_toxicity": op4_toxicity,
    "op5_token_counts": op5_token_counts,
    "op6_bpe": op6_bpe,
    "op7_simhash": op7_simhash,
    "op8_decontamination": op8_decontamination,
    "op9_extraction": op9_extraction,
    "op10_neighbours": op10_neighbours,
    "op11_collocations": op11_collocations,
    "op12_manifest": op12_manifest,
    "op13_urls": op13_urls,
}

# Where SQL can express an operator; the others meet a brute-force version in tests/llm.
SQL: dict[str, str] = {
    "op1_bytes": r"""
        WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        strings AS (
            SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS string
            FROM docs, unnest(range(0, len(h) // 2 - 99)) AS t(p)),
        firsts AS (
            SELECT string, min({'d': doc_id, 'p': p}) AS first FROM strings GROUP BY string HAVING count(*) > 1),
        repeats AS (
            SELECT doc_id, p FROM strings JOIN firsts USING (string) WHERE {'d': doc_id, 'p': p} <> first),
        later AS (
            SELECT doc_id, p, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, -1) AS begins
            FROM repeats),
        numbered AS (SELECT *, count(*) FILTER (begins) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM later),
        spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, run),
        cuts AS (
            SELECT doc_id, a, b FROM spans
            UNION ALL SELECT doc_id, len(h) // 2 AS a, len(h) // 2 AS b FROM docs),
        gaps AS (
            SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS since FROM cuts)
        SELECT d.doc_id, any_value(len(h) // 2) AS n_bytes, sum(g.b - g.a)::BIGINT AS n_removed,
            count(*) - 1 AS n_spans,
            sha256(unhex(string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a, b))) AS kept_sha256
        FROM docs d JOIN gaps g ON d.doc_id = g.doc_id GROUP BY d.doc_id""",
    "op3_lines": r"""
        WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
        lines AS (
            SELECT doc_id, lines, n, lines[n] AS line,
                len(regexp_extract_all(lines[n], '[^ \t\r\f\x0B]+')) AS words
            FROM docs, unnest(range(1, len(lines) + 1)) AS t(n)),
        sums AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM lines),
        runs AS (
            SELECT x.doc_id, x.lines, x.n AS s, min(y.n) AS e FROM sums x JOIN sums y
                ON x.doc_id = y.doc_id AND y.upto >= x.upto - x.words + 5 GROUP BY ALL
            UNION
            SELECT y.doc_id, y.lines, max(x.n) AS s, y.n AS e FROM sums x JOIN sums y
                ON x.doc_id = y.doc_id AND x.upto - x.words <= y.upto - 5 GROUP BY ALL),
        later AS (
            SELECT doc_id, s, e, row_number() OVER (
                PARTITION BY array_to_string(lines[s:e], chr(10)) ORDER BY doc_id, s) AS nth
            FROM runs),
        lost AS (SELECT DISTINCT doc_id, n FROM later, unnest(range(s, e + 1)) AS t(n) WHERE nth > 1)
        SELECT l.doc_id, count(*) AS n_lines, count(d.n) AS n_removed,
            sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.n) FILTER (d.n IS NULL), '')) AS kept_sha256
        FROM lines l LEFT JOIN lost d ON l.doc_id = d.doc_id AND l.n = d.n
        GROUP BY l.doc_id""",
    "op8_decontamination": r"""
        WITH lowered AS (
            SELECT true AS test, item_id AS id, text FROM benchmark
            UNION ALL SELECT false, doc_id, text FROM documents),
        words AS (
            SELECT test, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM lowered),
        items AS (SELECT id AS item_id, w, least(len(w), 13) AS size FROM words WHERE test AND len(w) > 0),
        windows AS (
            SELECT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS phrase
            FROM items, unnest(range(1, len(w) - size + 2)) AS t(p)),
        places AS (
            SELECT id AS doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS phrase
            FROM words, (SELECT DISTINCT size FROM items) AS s, unnest(range(1, len(w) - size + 2)) AS t(p)
            WHERE NOT test),
        hits AS (SELECT doc_id, p, size, item_id FROM places JOIN windows USING (size, phrase)),
        hit_words AS (
            SELECT doc_id, count(DISTINCT n) AS n_hit FROM hits, unnest(range(p, p + size)) AS t(n) GROUP BY doc_id),
        hit_items AS (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits),
        named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM hit_items GROUP BY doc_id)
        SELECT id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM words LEFT JOIN hit_words h ON id = h.doc_id LEFT JOIN named n ON id = n.doc_id WHERE NOT test""",
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece
            FROM documents),
        worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
        places AS (
            SELECT lang, size, unnest([array_to_string(w[p:p + size - 1], ' ') for p in range(1, len(w) - size + 2)]) AS phrase
            FROM worded, range(1, 6) AS s(size)),
        counts AS (SELECT lang, phrase, size, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100),
        cuts AS (
            SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, t.n,
                (1000 * c.f::HUGEINT * t.n) // (x.f::HUGEINT * y.f) AS score, k
            FROM counts c, range(1, 5) AS s(k), counts x, counts y, totals t
            WHERE c.size > k AND x.lang = c.lang AND y.lang = c.lang AND t.lang = c.lang
                AND x.phrase = array_to_string(string_split(c.phrase, ' ')[:k], ' ')
                AND y.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ')),
        lowest AS (
            SELECT lang, phrase, a, min({'score': score, 'k': k, 'l': l, 'r': r, 'n': n}) AS cut
            FROM cuts GROUP BY lang, phrase, a),
        scored AS (SELECT lang, phrase, a, unnest(cut) FROM lowest),
        left_over AS (
            SELECT * FROM scored s WHERE NOT EXISTS (
                SELECT 1 FROM counts c WHERE c.lang = s.lang AND c.f >= s.a AND len(c.phrase) > len(s.phrase)
                    AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' '))),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
    "op12_manifest": r"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, lang, text, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
                    || coalesce(strlen(source) || ':' || source, '-')
                    || coalesce(strlen(lang) || ':' || lang, '-') AS a,
                coalesce(strlen(text) || ':' || text, '-') AS b
            FROM documents),
        bytes AS (
            SELECT DISTINCT doc_id, p, ascii(substr(doc_id::VARCHAR, p, 1)) AS byte
            FROM documents, unnest(range(1, strlen(doc_id::VARCHAR) + 1)) AS t(p)),
        crc_steps(doc_id, p, bit, crc) AS (
            SELECT DISTINCT doc_id, 1, 0, xor(4294967295::BIGINT, ascii(doc_id::VARCHAR)) FROM documents
            WHERE doc_id IS NOT NULL
            UNION ALL
            SELECT s.doc_id, s.p + (s.bit = 8)::INT, CASE WHEN s.bit = 8 THEN 0 ELSE s.bit + 1 END,
                CASE WHEN s.bit = 8 THEN xor(s.crc, b.byte) WHEN s.crc & 1 = 1 THEN xor(s.crc >> 1, 3988292384)
                    ELSE s.crc >> 1 END
            FROM crc_steps s LEFT JOIN bytes b ON s.bit = 8 AND b.doc_id = s.doc_id AND b.p = s.p + 1
            WHERE s.bit < 8 OR b.byte IS NOT NULL),
        crcs AS (SELECT doc_id, xor(4294967295::BIGINT, arg_max(crc, p * 9 + bit)) AS crc FROM crc_steps GROUP BY doc_id),
        leaves AS (
            SELECT doc_id, lang, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || b) AS leaf,
                CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL
                    THEN sha256(a || strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1) || b)
                    END AS tampered
            FROM docs LEFT JOIN crcs USING (doc_id)),
        spots AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                count(*) OVER (PARTITION BY lang) AS n
            FROM leaves),
        nodes(lang, level, i, n, digest) AS (
            SELECT lang, 0, i, n, leaf FROM spots
            UNION ALL
            SELECT lang, level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY i))
            FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2),
        subroots AS (
            SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
            FROM nodes WHERE n = 1),
        uppers(level, i, n, digest) AS (
            SELECT 0, i, n, subroot FROM subroots
            UNION ALL
            SELECT level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY i))
            FROM uppers WHERE n > 1 GROUP BY level, i // 2),
        steps AS (
            SELECT s.lang, s.i, o.level, o.i & 1 AS side, m.digest AS other
            FROM spots s JOIN nodes o ON o.lang IS NOT DISTINCT FROM s.lang AND o.i = s.i >> o.level AND o.n > 1
            LEFT JOIN nodes m ON m.lang IS NOT DISTINCT FROM s.lang AND m.level = o.level AND m.i = xor(o.i, 1)
            UNION ALL
            SELECT s.lang, s.i, 1000 + o.level, o.i & 1 AS side, m.digest AS other
            FROM spots s JOIN subroots t ON s.lang IS NOT DISTINCT FROM t.lang
            JOIN uppers o ON o.i = t.i >> o.level AND o.n > 1
            LEFT JOIN uppers m ON m.level = o.level AND m.i = xor(o.i, 1)),
        ways AS (
            SELECT lang, i, string_agg(other, '' ORDER BY level) AS siblings,
                list({'side': side, 'other': other} ORDER BY level) AS way
            FROM steps GROUP BY lang, i),
        folds(lang, i, k, way, digest) AS (
            SELECT s.lang, s.i, 0, coalesce(w.way, []), coalesce(s.tampered, s.leaf)
            FROM spots s LEFT JOIN ways w ON w.lang IS NOT DISTINCT FROM s.lang AND w.i = s.i
            UNION ALL
            SELECT lang, i, k + 1, way, sha256(CASE WHEN way[k + 1].other IS NULL THEN digest
                WHEN way[k + 1].side = 1 THEN way[k + 1].other || digest ELSE digest || way[k + 1].other END)
            FROM folds WHERE k < len(way))
        SELECT s.doc_id, s.leaf, t.subroot, u.digest AS root, sha256(coalesce(w.siblings, '')) AS proof_sha256,
            f.digest AS folded_root, f.digest = u.digest AS verified
        FROM spots s JOIN subroots t ON s.lang IS NOT DISTINCT FROM t.lang
        JOIN folds f ON f.lang IS NOT DISTINCT FROM s.lang AND f.i = s.i AND f.k = len(f.way)
        LEFT JOIN ways w ON w.lang IS NOT DISTINCT FROM s.lang AND w.i = s.i
        JOIN uppers u ON u.n = 1""",
    "op13_urls": r"""
        WITH rules(host, path, verdict) AS (
            VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        rests AS (
            SELECT row_number() OVER () AS row, page_id,
                CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        parts AS (
            SELECT row, page_id, regexp_extract(rest, '^[^/?#]*') AS host,
                regexp_extract(substr(rest, len(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
            FROM rests),
        judged AS (
            SELECT p.row, max({'n': len(r.host || r.path), 'host': len(r.host), 'rule': r.host || r.path, 'verdict': r.verdict}) AS best
            FROM parts p JOIN rules r ON starts_with(p.path, r.path) AND ends_with('.' || translate(
                p.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.' || r.host)
            GROUP BY p.row)
        SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path,
            best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
        FROM parts LEFT JOIN judged USING (row)""",
}
