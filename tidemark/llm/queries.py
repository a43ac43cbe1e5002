"""The operators' queries over the driver's tables, and SQL for those that it can state."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .chat import format_preferences
from .decontam import contaminated
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_join
from .near_dedup import near_dedup
from .packing import pack
from .quality import classify_quality
from .spelling import spelling_variants
from .substring import repeated_passages
from .token_file import read_tokens, write_tokens
from .toxicity import score_toxicity
from .warc import read_warc, write_warc
from .whitening import whiten

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents"), k=4, percent=80)


def op3_quality(spark, sf_dir):
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_file(spark, sf_dir):
    manifest = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_warc(spark, sf_dir):
    records = read_warc(write_warc(table(spark, sf_dir, "pages")), payload=False).where("last")
    return records.select("page_id", "payload_bytes", F.coalesce("running", "digest").alias("payload_digest"), "record_type", "refers_to")


def op10_preferences(spark, sf_dir):
    return format_preferences(table(spark, sf_dir, "conversations"))


def op11_whitening(spark, sf_dir):
    rows = whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"), k=4, percent=85)


def op13_spelling(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


_ALL = (
    op1_exact_dedup, op2_near_dedup, op3_quality, op4_decontamination, op5_substring, op6_packing, op7_toxicity,
    op8_token_file, op9_warc, op10_preferences, op11_whitening, op12_jaccard_join, op13_spelling,
)
QUERIES = {f.__name__: f for f in _ALL}

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, {5 * i + 1}, 5) AS INTEGER) >> {b}) & 31) + 1, 1)" for i in range(8) for b in (15, 10, 5, 0))


def _crc_table() -> list[int]:
    """What each byte does to a CRC-32 with the reflected polynomial EDB88320."""
    out = list(range(256))
    for _ in range(8):
        out = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in out]
    return out


def _linked_components(percent: int, *more: str) -> str:
    """Documents, the sizes of their sets of 4-word shingles, and the smallest id they reach."""
    more = "".join(", " + m for m in more)
    return f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
        links AS (
            SELECT c.a, c.b FROM (
                SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) c
            JOIN sizes p ON p.doc_id = c.a JOIN sizes q ON q.doc_id = c.b
            WHERE 100 * c.n >= {percent} * (p.n + q.n - c.n)),
        reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
        SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id{more}
        FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id"""


SQL = {
    "op1_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents)
        WINDOW w AS (PARTITION BY t)""",
    "op2_near_dedup": _linked_components(80, "r.doc_id = min(r.other) AS kept"),
    "op4_decontamination": """
        WITH texts AS (
            SELECT 0 AS of_item, doc_id AS id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
            UNION ALL
            SELECT 1, item_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') FROM benchmark),
        lengths AS (SELECT DISTINCT least(len(w), 5) AS k FROM texts WHERE of_item = 1 AND len(w) > 0),
        shingles AS (
            SELECT DISTINCT of_item, id, array_to_string(w[i:i + k - 1], ' ') AS s
            FROM (SELECT of_item, id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM texts JOIN lengths
                  ON CASE of_item WHEN 1 THEN k = least(len(w), 5) ELSE k <= len(w) END)),
        sizes AS (SELECT id AS item_id, count(*) AS n FROM shingles WHERE of_item = 1 GROUP BY 1)
        SELECT c.doc_id, c.item_id, n AS n_shingles, c.m AS n_contained FROM (
            SELECT d.id AS doc_id, b.id AS item_id, count(*) AS m
            FROM shingles d JOIN shingles b ON d.s = b.s AND d.of_item = 0 AND b.of_item = 1 GROUP BY 1, 2) c
        JOIN sizes USING (item_id) WHERE 100 * c.m >= 80 * n""",
    "op9_warc": f"""
        WITH d AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, h, min(page_id) OVER (PARTITION BY t) AS first_id
                   FROM (SELECT page_id, t, sha1(t) AS h FROM (SELECT page_id, coalesce(html, '') AS t FROM pages)))
        SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM d""",
    "op10_preferences": """
        WITH t AS (
            SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role,
                   '<|im_start|>' || coalesce(role, '') || chr(10) ||
                   replace(replace(coalesce(text, ''), '<|im_start|>', '<|im_start |>'), '<|im_end|>', '<|im_end |>') ||
                   '<|im_end|>' || chr(10) AS rendered
            FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        first AS (SELECT conv_id, arg_min(rendered, (turn, rendered)) AS f FROM t GROUP BY 1),
        pairs AS (
            SELECT chosen_id, rejected_id, CASE WHEN min(p) = 1 THEN 'opening' ELSE 'neighbour' END AS pairing FROM (
                SELECT a.chosen_id, b.conv_id AS rejected_id, 1 AS p FROM first b
                JOIN (SELECT f, min(conv_id) AS chosen_id FROM first GROUP BY 1) a ON a.f = b.f AND a.chosen_id <> b.conv_id
                UNION ALL
                SELECT a.conv_id, b.conv_id, 2 FROM first a JOIN first b ON a.conv_id % 2 = 0 AND b.conv_id = a.conv_id + 1)
            GROUP BY 1, 2),
        marks AS (SELECT conv_id, turn, list(rendered ORDER BY rendered) AS m FROM t GROUP BY 1, 2),
        split AS (
            SELECT chosen_id, rejected_id, min(turn) AS split FROM (
                SELECT p.chosen_id, p.rejected_id, m.turn, m.m, count(*) OVER (PARTITION BY p.chosen_id, p.rejected_id, m.turn, m.m) AS same
                FROM pairs p JOIN marks m ON m.conv_id IN (p.chosen_id, p.rejected_id))
            WHERE same = 1 GROUP BY 1, 2),
        cut AS (SELECT p.*, coalesce(s.split, 4611686018427387904) AS split FROM pairs p LEFT JOIN split s USING (chosen_id, rejected_id))
        SELECT *, part <> 'prompt' AND role = 'assistant' AS loss FROM (
            SELECT chosen_id, rejected_id, pairing, CASE WHEN turn < split THEN 'prompt' ELSE 'chosen' END AS part, turn, role, rendered
            FROM cut JOIN t ON t.conv_id = chosen_id
            UNION ALL
            SELECT chosen_id, rejected_id, pairing, 'rejected', turn, role, rendered
            FROM cut JOIN t ON t.conv_id = rejected_id AND turn >= split)""",
    "op12_jaccard_join": _linked_components(85),
    "op13_spelling": f"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, w, count(*) AS n FROM (
                SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents)
            GROUP BY 1, 2),
        bytes AS (
            SELECT doc_id, w, n, list_transform(range(1, CAST(length(h) AS BIGINT), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)) AS b
            FROM (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS h FROM runs)),
        hashed AS (
            SELECT w, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x:
                xor(c >> 8, CAST({_crc_table()}[(xor(c, x) & 255) + 1] AS BIGINT)))) AS h
            FROM bytes),
        words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
                SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM hashed)
            GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
        holes AS (
            SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS hole FROM (
                SELECT word, n, unnest(range(1, CAST(length(word) AS BIGINT) + 1)) AS i FROM words)),
        near AS (
            SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word
            UNION
            SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.hole = b.word
            UNION
            SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.hole = b.word),
        best AS (SELECT word, count(*) AS n_near, min((-near_n, near)) AS best FROM near GROUP BY 1),
        forms AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * w.n THEN best[2] END AS form,
                   CASE WHEN -best[1] >= 2 * w.n THEN -best[1] END AS form_n
            FROM words w LEFT JOIN best b ON b.word = w.word),
        chain AS (
            SELECT word, word AS root FROM forms
            UNION ALL
            SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f
        JOIN (SELECT c.word, c.root FROM chain c JOIN forms e ON e.word = c.root AND e.form IS NULL) c ON c.word = f.word""",
}
