"""Registered queries of the subpackage: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A score from which on a document counts as toxic.
TOXIC_FROM = 0.3


def held_out():
    """Rows whose labels nothing is learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def toxicity_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    from phenospark.llm.toxicity import toxicity_scores

    return toxicity_scores(docs, labels, usable=~held_out())


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_of(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.warc import archived

    return archived(_table(spark, sf_dir, "pages"), least_bytes=1000).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
     m AS (SELECT html, max(page_id) AS response FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < response THEN response END AS refers_to
FROM p LEFT JOIN m ON p.html = m.html
"""


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.linechunks import without_repeated_chunks

    return without_repeated_chunks(_table(spark, sf_dir, "documents")).select(
        "doc_id", F.length("text").cast("long").alias("n_kept_chars"), F.col("chunks_removed").cast("long").alias("chunks_removed"),
        F.sha2("text", 256).alias("text_sha256"))


OP3 = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
     h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS v FROM l),
     b AS (SELECT *, i = max(i) OVER (PARTITION BY doc_id)
                     OR (i >= 2 AND (v + 31 * lag(v) OVER (PARTITION BY doc_id ORDER BY i)) % 3 = 0) AS ends FROM h),
     n AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM b),
     chunks AS (SELECT doc_id, c, count(*) AS k, string_agg(line, chr(10) ORDER BY i) AS body FROM n GROUP BY doc_id, c),
     judged AS (SELECT *, k >= 2 AND row_number() OVER (PARTITION BY body ORDER BY k < 2, doc_id, c) > 1 AS gone FROM chunks),
     kept AS (SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY c) FILTER (NOT gone), '') AS text,
                     count(*) FILTER (gone) AS chunks_removed FROM judged GROUP BY doc_id)
SELECT doc_id, length(text)::BIGINT AS n_kept_chars, chunks_removed::BIGINT AS chunks_removed, sha256(text) AS text_sha256 FROM kept
"""


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.records import encoded_documents

    return encoded_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.jaccard import jaccard_links

    return jaccard_links(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


OP5 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     s AS MATERIALIZED (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
     n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
     links AS MATERIALIZED (SELECT a, b, c, p.n AS na, q.n AS nb FROM common JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),
     reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
     class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
     degree AS (SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (c = na AND c = nb) AS copies FROM links GROUP BY a)
SELECT class.doc_id, class_id, coalesce(n_links, 0) AS n_links, 1 + coalesce(copies, 0) AS n_copies
FROM class LEFT JOIN degree ON class.doc_id = degree.doc_id
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     windows AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS words
                 FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT len(words) AS n FROM windows),
     places AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS words
                FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
     found AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (words)),
     hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
     items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
               FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.substrings import without_repeats

    return without_repeats(_table(spark, sf_dir, "documents"), length=50).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP7 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
     s AS MATERIALIZED (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 100)) AS g FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS i FROM d WHERE len(x) >= 100)),
     f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g HAVING count(*) > 1),
     b AS (SELECT doc_id, i AS a, i + 50 AS e FROM s JOIN f USING (g) WHERE doc_id > first),
     r AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
     n AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a) AS k FROM r),
     spans AS (SELECT doc_id, k, min(a) AS a, max(e) AS e FROM n GROUP BY doc_id, k),
     gaps AS (SELECT doc_id, coalesce(lag(e) OVER w, 0) AS a, spans.a AS e FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY spans.a)
              UNION ALL SELECT spans.doc_id, max(spans.e), any_value(len(x) // 2) FROM spans JOIN d USING (doc_id) GROUP BY spans.doc_id),
     kept AS (SELECT gaps.doc_id, string_agg(substr(x, 2 * a + 1, 2 * (e - a)), '' ORDER BY a) AS y FROM gaps JOIN d USING (doc_id) GROUP BY gaps.doc_id),
     sums AS (SELECT doc_id, sum(e - a) AS removed, count(*) AS n FROM spans GROUP BY doc_id)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN sums ON d.doc_id = sums.doc_id
"""


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.secrets import scanned_documents, spelled

    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned_documents(_table(spark, sf_dir, "documents")).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(spelled("spans"), 256).alias("base_sha256"), spelled("spans").alias("spans"))


def _op8_kind(rank: int, kind: str, pattern: str, measured: str, least: int, hint: str) -> str:
    """Spans of one kind: the text between the matches and the matches, in a row,
    over the documents that can have a span at all."""
    p = pattern.replace("'", "''")
    return f"""
SELECT doc_id, {rank} AS rank, '{kind}' AS kind, e - length(hit) AS s, length(hit) AS len
FROM (SELECT doc_id, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY n ORDER BY i)::BIGINT AS e
      FROM (SELECT doc_id, n, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i
            FROM (SELECT doc_id, n, regexp_extract_all(text, '{p}', 0) AS hits, string_split_regex(text, '{p}') AS gaps
                  FROM (SELECT doc_id, row_number() OVER () AS n, text FROM documents WHERE regexp_matches(text, '{hint.replace("'", "''")}')))))
WHERE length({measured.replace("$p", "'" + p + "'")}) >= {least}"""


_ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
OP8 = f"""
WITH found AS ({' UNION ALL '.join([
    _op8_kind(0, "assign", _ASSIGN, "regexp_extract(hit, $p, 1)", 12, _ASSIGN),
    _op8_kind(1, "access", "AKIA[A-Z0-9]+", "hit", 18, "AKIA[A-Z0-9]{14}"),
    _op8_kind(2, "hex", "[0-9a-f]+", "hit", 16, "[0-9a-f]{16}")])}),
     listed AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                       count(*) FILTER (kind = 'hex') AS n_hex,
                       string_agg(kind || ':' || s || ':' || (s + len), ',' ORDER BY s, rank) AS spans
                FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id
"""


def op9_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.fingerprints import with_neighbours

    return with_neighbours(_table(spark, sf_dir, "documents")).drop("next_fingerprint")


def op10_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    from phenospark.llm.packing import pack

    return pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, sequence=1024).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.alignment import token_alignment

    return token_alignment(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.conversations import repair

    return repair(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_warc_bundles": op2_warc_bundles,
    "op3_line_chunks": op3_line_chunks,
    "op4_token_records": op4_token_records,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_decontamination": op6_decontamination,
    "op7_repeated_strings": op7_repeated_strings,
    "op8_secret_ledger": op8_secret_ledger,
    "op9_edit_fingerprints": op9_edit_fingerprints,
    "op10_mixture_packing": op10_mixture_packing,
    "op11_token_alignment": op11_token_alignment,
    "op12_simhash_components": op12_simhash_components,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op2_warc_bundles": OP2,
    "op3_line_chunks": OP3,
    "op5_jaccard_join": OP5,
    "op6_decontamination": OP6,
    "op7_repeated_strings": OP7,
    "op8_secret_ledger": OP8,
}
