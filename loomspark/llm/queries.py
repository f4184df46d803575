"""The registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flac, kdtree, mainline, mixing, mixlm, packing, secrets, simhash, simple8b, slices, toxicity, turns, warc
from .common import table


def word_vocabulary() -> str:
    """The vocabulary file that the token queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainline.extract(table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), word_vocabulary())


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_mixing_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixlm.score(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(table(spark, sf_dir, "documents"))


def op6_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.through_storage(table(spark, sf_dir, "documents"))


def op7_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.read_token_files(simple8b.write_token_files(table(spark, sf_dir, "documents"), word_vocabulary()))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = mixing.mixing_report(table(spark, sf_dir, "documents"))
    positions = [F.get("positions", F.lit(i)).alias(n) for i, n in enumerate(("first_position", "second_position"))]
    return report.select("doc_id", "size", "source_size", "target", "taken", *positions)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.through_archives(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damage(table(spark, sf_dir, "conversations")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = {}

SQL["op9_source_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, md5(COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || COALESCE(md5(text), '')) AS k,
         COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         CASE (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         ROW_NUMBER() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT SUM(source_size) FROM sources)
         - COALESCE(SUM(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / SUM(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
targets AS (
  SELECT source, source_size, CASE (rank - 1) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS tilt,
         LEAST(cap, COALESCE((SELECT FIRST(level ORDER BY cap / weight, rank) FROM levels WHERE cap > level * weight) * weight, cap)) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.tilt,
         COALESCE(SUM(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s.size / 2.0::DOUBLE AS middle
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, size > 0 AND middle < target AS one, size > 0 AND source_size + middle < target AS two,
         middle / target AS share, (source_size + middle) / target AS later
  FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (CASE WHEN one THEN 1 ELSE 0 END + CASE WHEN two THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CASE WHEN NOT one THEN NULL WHEN tilt = 0 THEN share
            ELSE ((1 + tilt) - sqrt((1 + tilt) * (1 + tilt) - 4 * tilt * share)) / (2 * tilt) END AS first_position,
       CASE WHEN NOT two THEN NULL WHEN tilt = 0 THEN later
            ELSE ((1 + tilt) - sqrt((1 + tilt) * (1 + tilt) - 4 * tilt * later)) / (2 * tilt) END AS second_position
FROM copies
"""

SQL["op10_exact_top_k"] = r"""
WITH v AS (
  SELECT ROW_NUMBER() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.x) = len(c.x)),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


SQL["op11_warc_dictionary"] = """
WITH hashed AS (
  SELECT page_id, url, sha1(COALESCE(html, '')) AS h, CAST(strlen(COALESCE(html, '')) AS BIGINT) AS payload_bytes FROM pages),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS place, FIRST_VALUE(page_id) OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS kept FROM hashed)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT)
         >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE place WHEN 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN kept END AS refers_to
FROM ranked
"""


def _with(weight: str, cost: str, label: str) -> str:
    """A weight, its cost in nine digits and then its labels, so that strings compare as weights do, with one more label."""
    return f"lpad(CAST(CAST(left({weight}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({weight}, 10) || '{label}'"


_INSERTED = f"""LEAST(v2, {_with("v0", "2", "I")}, {_with("v1", "2", "I")}, {_with("v3", "2", "I")}) AS w2"""
_INSERTED_TOO = f"""LEAST(v3, {_with("w2", "2", "I")}) AS w3"""
_STAYS = "fault NOT IN ('b', 'd')"
_CUT = "(CASE fault WHEN 't' THEN 1 ELSE 0 END)"


def _kept(initial: str, *states: str) -> str:
    return ", ".join(f"CASE WHEN {_STAYS} AND initial = '{initial}' THEN {_with(v, _CUT, 'K')} END" for v in states)


def _reroled(*states: str) -> str:
    return ", ".join(f"CASE WHEN {_STAYS} THEN {_with(v, '2 + ' + _CUT, 'R')} END" for v in states)


SQL["op12_conversation_repair"] = rf"""
WITH RECURSIVE
coded AS (
  SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
         COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT)),
                lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS hit
  FROM coded),
damaged AS (
  SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed),
numbered AS (
  SELECT *, left(role, 1) AS initial, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM damaged),
marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b'
                 WHEN ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd'
                 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 't' ELSE '.' END AS fault,
         LAG(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial NOT IN ('su', 'ua', 'au') AS broken
  FROM numbered),
states AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, '000000000' AS v0, NULL::VARCHAR AS v1, NULL::VARCHAR AS v2, NULL::VARCHAR AS v3 FROM conversations
  UNION ALL
  SELECT conv_id, n, {_with("v0", "3", "D")},
         LEAST({_with("v1", "3", "D")}, {_kept("s", "v0")}),
         LEAST({_with("w2", "3", "D")}, {_kept("u", "v0", "v1", "w3")}, {_reroled("v0", "v1", "w3")}),
         LEAST({_with("w3", "3", "D")}, {_kept("a", "w2")}, {_reroled("w2")})
  FROM (SELECT s.conv_id, m.n, v0, v1, w2, {_INSERTED_TOO}, m.initial, m.fault
        FROM (SELECT *, {_INSERTED} FROM states) s JOIN marked m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.n = s.n + 1)),
best AS (
  SELECT conv_id, LEAST(v0, w3) AS best
  FROM (SELECT *, {_INSERTED_TOO} FROM (SELECT *, {_INSERTED} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY n DESC) AS last FROM states) WHERE last = 1))),
paths AS (
  SELECT conv_id, CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM best),
labels AS (
  SELECT conv_id, p, substr(audit, p, 1) AS label FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM paths)),
placed AS (
  SELECT *, COUNT(*) FILTER (label <> 'I') OVER w AS n, COUNT(*) FILTER (label <> 'D') OVER w AS o FROM labels WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
taken AS (
  SELECT p.conv_id, p.label, p.o, CASE WHEN p.label <> 'I' THEN m.role END AS role, CASE WHEN p.label <> 'I' THEN m.text ELSE '' END AS text,
         COALESCE(BOOL_OR(p.o = 1 AND p.label = 'K' AND m.initial = 's') OVER (PARTITION BY p.conv_id), FALSE) AS led
  FROM placed p LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.n = p.n WHERE p.label <> 'D'),
written AS (
  SELECT conv_id, string_agg(CASE WHEN label = 'K' THEN role WHEN (o - CAST(led AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY o) AS lines
  FROM taken GROUP BY conv_id),
counts AS (
  SELECT conv_id, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (fault = 'b') AS blank, COUNT(*) FILTER (fault = 'd') AS duplicate,
         COUNT(*) FILTER (fault = 't') AS truncated, COUNT(*) FILTER (broken) AS illegal
  FROM marked GROUP BY conv_id)
SELECT p.conv_id, CAST(COALESCE(gaps, 0) AS BIGINT) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated,
       COALESCE(illegal, 0) AS illegal, cost, audit, sha256(COALESCE(lines, '')) AS repaired_sha256
FROM paths p LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM p.conv_id
"""
SQL["op13_ranked_search"] = r"""
WITH words AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT ROW_NUMBER() OVER () AS row, doc_id, text FROM documents)),
tf AS (SELECT row, doc_id, term, COUNT(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT row, CAST(SUM(tf) AS BIGINT) AS n FROM tf GROUP BY row),
totals AS (SELECT COUNT(*) AS docs, CAST(SUM(n) AS BIGINT) AS words FROM sizes),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * COUNT(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, totals GROUP BY term, docs),
items AS (
  SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT ROW_NUMBER() OVER () AS item, item_id, text FROM benchmark)),
asked AS (SELECT item, item_id, term, COUNT(*) AS q FROM items GROUP BY ALL),
scored AS (
  SELECT item, item_id, t.row, t.doc_id, CAST(SUM(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked a JOIN tf t ON a.term = t.term JOIN weights v ON v.term = a.term JOIN sizes s ON s.row = t.row, totals GROUP BY ALL),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_mixing_model_scores": op4_mixing_model_scores,
    "op5_secret_scan": op5_secret_scan,
    "op6_flac_media": op6_flac_media,
    "op7_toxicity_neighbours": op7_toxicity_neighbours,
    "op8_token_files": op8_token_files,
    "op9_source_mixing": op9_source_mixing,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_warc_dictionary": op11_warc_dictionary,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_ranked_search": op13_ranked_search,
}
