"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credilake.llm import blocks, bpe, centroids, html, lines, merkle, mixing, repair, rules, shards, simhash, suffix, weak
from credilake.llm.base import documents

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(documents(spark, sf_dir), vocabulary_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return suffix.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id",
        "n_bytes",
        gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(documents(spark, sf_dir)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text against itself with its second half overwritten, and against the next text."""

    last: dict[str, merkle.Node] = {}  # the text that follows is compared next

    def compare(text: str, follows: str) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        own = last.get(text) or merkle.tree(text.encode())
        new, other = merkle.tree(edited.encode()), merkle.tree(follows.encode())
        last.clear()
        last[follows] = other
        digest = sha256(edited.encode()).hexdigest()
        likeness = merkle.likeness(own, new), merkle.likeness(own, other)
        return len(text), digest, own.digest.hex(), new.digest.hex(), *likeness

    return merkle.with_next(
        documents(spark, sf_dir),
        compare,
        "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return weak.judge(docs.select("doc_id", "text"), weak.fit(docs)).select(
        "doc_id", "weak_label", "score", (F.col("score") >= weak.THRESHOLD).alias("kept")
    )


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroid = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return centroids.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(centroid, 256).alias("centroid_sha256")
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The damage that op12 mends, by crc32 of conversation and turn: a row in twenty each is dropped, emptied, robbed
    of its sentence ends, said twice, or given to the user."""
    text = {n: F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"]).cast("binary")) % 20
    said = F.when(kind == 1, "").when(kind == 2, F.translate(text["text"], ".!?", "")).otherwise(text["text"])
    return (
        conversations.where(kind != 0)
        .withColumn("copy", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("conv_id", "turn", F.when(kind == 4, "user").otherwise(text["role"]).alias("role"), said.alias("text"))
    )


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair.repair_conversations(damaged(conversations), conversations)


def op13_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return blocks.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_suffix_array": op2_suffix_array,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash": op4_simhash,
    "op5_sharding": op5_sharding,
    "op6_merkle": op6_merkle,
    "op7_mixing": op7_mixing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_html_extraction": op9_html_extraction,
    "op10_quality_rules": op10_quality_rules,
    "op11_centroids": op11_centroids,
    "op12_repair": op12_repair,
    "op13_blocks": op13_blocks,
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = "[^\\x20\\x09-\\x0D]+"

LINE_SQL = f"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
k AS (
  SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.*, s.key IS NOT NULL AND doc_id <> keeper AS dropped FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS kept
FROM m GROUP BY doc_id"""

_stop = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
_limit = {k: tuple(v) for k, v in rules.THRESHOLDS.items()}

RULES_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
u AS (
  SELECT doc_id, generate_subscripts(words, 1) AS pos, unnest(words) AS a FROM w),
g AS (
  SELECT *, lead(a, 1) OVER d AS b, lead(a, 2) OVER d AS c FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
r AS (
  SELECT doc_id, pos, c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a, b, c) >= 2 AS twice FROM g),
v AS (
  SELECT doc_id, twice OR coalesce(lag(twice, 1) OVER d, false) OR coalesce(lag(twice, 2) OVER d, false) AS covered
  FROM r WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
n AS (SELECT doc_id, count(*) FILTER (covered) AS n_repeat_words FROM v GROUP BY doc_id),
s AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x, {_BLANKS})) > 0) AS lines,
         length(list_filter(words, lambda x: x IN ({_stop}))) AS n_stop,
         length(list_filter(words, lambda x: suffix(x, '!!'))) AS n_shouts,
         length(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols
  FROM w),
t AS (
  SELECT s.*, length(lines) - length(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         n_words < {rules.MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM s LEFT JOIN n USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN {_limit["mean_word_length"][0]} AND {_limit["mean_word_length"][1]}
       AND n_symbols / word_chars <= {_limit["symbols_per_char"][1]}
       AND n_shouts / n_words <= {_limit["shouts_per_word"][1]}
       AND n_stop / n_words >= {_limit["stop_word_share"][0]}
       AND coalesce(n_dup_lines / nullif(length(lines), 0), 0) <= {_limit["dup_line_share"][1]} AS kept
FROM t"""

_weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))

MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (
  SELECT *, CASE (rank - 1) % {len(mixing.WEIGHTS)} {_weight} END AS weight, {mixing.SHARE} * sum(n) OVER () AS whole FROM s),
f AS (
  SELECT *, (whole - {mixing.MOST_EPOCHS} * coalesce(sum(n) OVER (ORDER BY n / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         * weight / sum(weight) OVER (ORDER BY n / weight DESC, rank DESC) > {mixing.MOST_EPOCHS} * n AS is_full
  FROM w),
l AS (
  SELECT (max(whole) - {mixing.MOST_EPOCHS} * coalesce(sum(n) FILTER (is_full), 0)) AS rest, sum(weight) FILTER (NOT is_full) AS among FROM f),
t AS (
  SELECT source, n, CASE WHEN is_full THEN CAST({mixing.MOST_EPOCHS} * n AS DOUBLE) ELSE CAST(rest AS DOUBLE) * weight / CAST(among AS DOUBLE) END AS target
  FROM f, l),
p AS (
  SELECT d.*, n, target, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('{mixing.SEED}:' || doc_id), doc_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n AS source_size, target,
       CAST(epochs * size + least(size, greatest(0, CAST(round(target) AS BIGINT) - epochs * n - before)) AS BIGINT) AS taken
FROM p"""

_round = """,
n{r} AS MATERIALIZED (
  SELECT r, CAST(min(d * 64 + k) % 64 AS INTEGER) AS k, min(d * 64 + k) // 64 AS d
  FROM (SELECT e.r, c.k, CAST(sum((e.x - c.x) * (e.x - c.x)) AS HUGEINT) AS d FROM e JOIN c{r} c USING (i) GROUP BY e.r, c.k) GROUP BY r)"""
_mean = """,
c{next} AS MATERIALIZED (
  SELECT c.k, c.i, coalesce(m.x, c.x) AS x
  FROM c{r} c LEFT JOIN (
    SELECT k, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x
    FROM (SELECT n{r}.k, e.i, CAST(sum(e.x) AS HUGEINT) AS s, count(*) AS n FROM n{r} JOIN e USING (r) GROUP BY n{r}.k, e.i)) m
  ON c.k = m.k AND c.i = m.i)"""

CENTROID_SQL = (
    f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r,
         list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {centroids.DIMENSIONS}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.DIMENSIONS}),
e AS MATERIALIZED (SELECT r, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM v),
f AS (
  SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS k, v FROM v
  QUALIFY k < {centroids.CLUSTERS}),
c0 AS MATERIALIZED (SELECT CAST(k AS INTEGER) AS k, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM f)"""
    + "".join(_round.format(r=r) + _mean.format(r=r, next=r + 1) for r in range(centroids.ROUNDS))
    + _round.format(r=centroids.ROUNDS)
    + f""",
h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{centroids.ROUNDS} GROUP BY k)
SELECT vec_id, n.k AS cluster, CAST(n.d AS BIGINT) AS distance, CAST(sum(n.d) OVER (PARTITION BY n.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(n.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM n{centroids.ROUNDS} n JOIN v USING (r) JOIN h ON h.k = n.k"""
)

BLOCK_SQL = f"""
WITH w AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
p AS MATERIALIZED (
  SELECT d, i, md5(array_to_string(words[i:i + {blocks.WINDOW - 1}], ' ')) AS h
  FROM (SELECT d, words, unnest(range(1, len(words) - {blocks.WINDOW - 2})) AS i FROM w)),
t AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
s AS (SELECT d, i FROM p SEMI JOIN t USING (h)),
u AS (SELECT d, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM w),
g AS (
  SELECT u.d, u.i, u.word, coalesce(max(s.i) OVER (PARTITION BY u.d ORDER BY u.i ROWS BETWEEN {blocks.WINDOW - 1} PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM u LEFT JOIN s ON u.d = s.d AND u.i = s.i),
k AS (
  SELECT d, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY d)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (d)"""

def _edit(state: str, cost: str, letter: str) -> str:
    """States of the repair's table are texts: ten digits of cost, then the audit, so that the least is the best."""
    return f"(lpad(CAST(CAST({state}[1:10] AS BIGINT) + {cost} AS VARCHAR), 10, '0') || {state}[11:] || {letter})"


def _inserted(x: str) -> tuple[str, str, str, str]:
    """The four states once turns may have been put in."""
    once = [_edit(f"{x}{i}", str(repair.INSERT), "'I'") for i in range(4)]
    twice = [_edit(f"{x}{i}", str(2 * repair.INSERT), "'II'") for i in range(2)]
    return f"{x}0", f"{x}1", f"least({x}2, {once[0]}, {once[1]}, {once[3]})", f"least({x}3, {once[2]}, {', '.join(twice)})"


_drop = [_edit(f"p{i}", str(repair.DELETE), "'D'") for i in range(4)]
_as_s = _edit("p0", f"{repair.TRUNCATED} * truncated", "'K'")
_as_u, _as_a = (
    _edit(p, f"{repair.TRUNCATED} * truncated + CASE WHEN initial = '{r}' THEN 0 ELSE {repair.REROLE} END", f"CASE WHEN initial = '{r}' THEN 'K' ELSE 'R' END")
    for p, r in (("least(p0, p1, p3)", "u"), ("p2", "a"))
)

REPAIR_SQL = f"""
WITH RECURSIVE z AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
o AS (SELECT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS d, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS key
      FROM conversations),
x AS (SELECT o.*, xor(list_reduce(list_prepend(4294967295, key), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM o, z),
m AS (SELECT d, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
      FROM x WHERE kind <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos, rtrim(text, {_BLANKS}) AS ends FROM m),
q AS (SELECT *, ends = '' AS blank, ends <> '' AND row_number() OVER (PARTITION BY d, role, text ORDER BY pos) > 1 AS duplicate, left(role, 1) AS initial,
        lag(left(role, 1)) OVER (PARTITION BY d ORDER BY pos) AS before FROM r),
f AS MATERIALIZED (
  SELECT *, blank OR duplicate AS gone, CASE WHEN blank OR duplicate OR right(ends, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS truncated FROM q),
s AS (
  SELECT DISTINCT d, CAST(0 AS BIGINT) AS pos, repeat('0', 10) AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM o
  UNION ALL
  SELECT d, pos, {_drop[0]}, CASE WHEN NOT gone AND initial = 's' THEN least({_drop[1]}, {_as_s}) ELSE {_drop[1]} END,
         CASE WHEN gone THEN {_drop[2]} ELSE least({_drop[2]}, {_as_u}) END, CASE WHEN gone THEN {_drop[3]} ELSE least({_drop[3]}, {_as_a}) END
  FROM (SELECT f.*, {", ".join(f"{e} AS p{i}" for i, e in enumerate(_inserted("s.s")))} FROM s JOIN f ON f.d = s.d AND f.pos = s.pos + 1)),
w AS (SELECT d, least(p0, p3) AS best FROM (
  SELECT s.d, {", ".join(f"{e} AS p{i}" for i, e in enumerate(_inserted("s.s")))}
  FROM s JOIN (SELECT d, max(pos) AS pos FROM s GROUP BY d) USING (d, pos))),
a AS (SELECT d, best[11:] AS audit, CAST(best[1:10] AS BIGINT) AS cost FROM w),
l AS (SELECT d, audit, generate_subscripts(string_split(audit, ''), 1) AS j, unnest(string_split(audit, '')) AS edit FROM a WHERE audit <> ''),
t AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY d ORDER BY j) AS pos, count(*) FILTER (edit <> 'D') OVER (PARTITION BY d ORDER BY j) - 1 AS place,
        length(replace(audit, 'D', '')) % 2 AS odd FROM l),
y AS (
  SELECT t.d, string_agg(CASE edit WHEN 'K' THEN role ELSE role_in END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole
  FROM (SELECT *, CASE WHEN (place - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END AS role_in FROM t) t LEFT JOIN f USING (d, pos) WHERE edit <> 'D' GROUP BY t.d),
g AS (
  SELECT d, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         CAST(sum(truncated) AS BIGINT) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY d)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT d, conv_id FROM o) JOIN a USING (d) LEFT JOIN g USING (d) LEFT JOIN y USING (d)"""

ORACLE: dict[str, str] = {
    "op12_repair": REPAIR_SQL,
    "op11_centroids": CENTROID_SQL,
    "op13_blocks": BLOCK_SQL,
    "op7_mixing": MIX_SQL,
    "op3_line_dedup": f"SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM ({LINE_SQL})",
    "op10_quality_rules": RULES_SQL,
}
