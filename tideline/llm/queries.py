"""One query per operator, over its whole table and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.llm import bpe, centroids, chunks, decontamination, html, licences, manifest, merkle, mixing, quality, sharding, simhash, tokens
from tideline.llm.hashing import SPAN, number_sql, row_key_sql
from tideline.llm.registry import QUERIES, SQL, query, table
from tideline.plans.scratch import freeze

__all__ = ["QUERIES", "SQL"]


@query
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op2_merkle_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = merkle.half_replaced(table(spark, sf_dir, "documents"))
    places = merkle.changed(F.col("tree"), F.col("edited_tree"))
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        merkle.root(F.col("tree")).alias("fingerprint"),
        merkle.root(F.col("edited_tree")).alias("edited_fingerprint"),
        merkle.likeness(F.col("tree.clauses"), F.col("edited_tree.clauses")).alias("near_edited"),
        merkle.likeness(F.col("tree.clauses"), F.col("next_clauses")).alias("near_next"),
        F.get(places, F.lit(0)).alias("_first"),
    ).select("*", F.col("_first.section").alias("changed_section"), F.col("_first.paragraph").alias("changed_paragraph")).drop("_first")


SQL["op2_merkle_tree"] = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
n AS (
    SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt FROM d
    WINDOW w AS (ORDER BY doc_id DESC NULLS LAST)),
e AS (
    SELECT *, substring(t, 1, length(t) - length(t) // 2) || substring(nt, 1, length(t) // 2) AS et FROM n),
trees AS (
    SELECT *,
        list_transform(string_split(t, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: sha256(p))) AS ta,
        list_transform(string_split(et, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: sha256(p))) AS tb,
        list_distinct(regexp_extract_all(t, '{merkle.CLAUSE}')) AS ca,
        list_distinct(regexp_extract_all(et, '{merkle.CLAUSE}')) AS cb,
        list_distinct(regexp_extract_all(nt, '{merkle.CLAUSE}')) AS cn
    FROM e),
sections AS (
    SELECT rid, min(struct_pack(s := s, p := p)) AS place
    FROM (SELECT rid, s, unnest(range(1, greatest(coalesce(len(ta[s]), 0), coalesce(len(tb[s]), 0)) + 1)) AS p, ta[s] AS x, tb[s] AS y
          FROM (SELECT rid, unnest(range(1, greatest(len(ta), len(tb)) + 1)) AS s, ta, tb FROM trees))
    WHERE x[p] IS DISTINCT FROM y[p] GROUP BY rid)
SELECT doc_id, length(t) AS n_chars, sha256(et) AS edited_sha256,
    sha256(array_to_string(list_transform(ta, lambda s: sha256(array_to_string(s, ''))), '')) AS fingerprint,
    sha256(array_to_string(list_transform(tb, lambda s: sha256(array_to_string(s, ''))), '')) AS edited_fingerprint,
    CASE WHEN len(ca) + len(cb) > 0 THEN 2.0 * len(list_intersect(ca, cb)) / (len(ca) + len(cb)) ELSE 1.0 END AS near_edited,
    CASE WHEN len(ca) + len(cn) > 0 THEN 2.0 * len(list_intersect(ca, cn)) / (len(ca) + len(cn)) ELSE 1.0 END AS near_next,
    CAST(place.s AS INT) AS changed_section, CAST(place.p AS INT) AS changed_paragraph
FROM trees LEFT JOIN sections USING (rid)"""


@query
def op3_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunks.dedup(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return cut.select("doc_id", "source", "text", F.length("text").cast("long").alias("n_chars"), "spans", words.alias("n_cut_words"))


SHARDS, SLOTS = [f"shard-{i:02d}" for i in range(32)], 3203


@query
def op4_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), sharding.lookup_table(spark, SHARDS, SLOTS), SLOTS)
    return placed.select("doc_id", "slot", "shard")


# One row per probe: whose turn it is, where it looks, and whether that was free.
SQL["op4_shard_lookup"] = f"""
WITH RECURSIVE shards AS (
    SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 2, '0') AS name FROM range({len(SHARDS)}) t(i)),
orders AS (
    SELECT list({number_sql("'offset'", "name")} % {SLOTS} ORDER BY i) AS offsets,
           list({number_sql("'skip'", "name")} % {SLOTS - 1} + 1 ORDER BY i) AS skips FROM shards),
probes AS (
    SELECT 0 AS turn, list_transform(range({len(SHARDS)}), lambda x: 0) AS seen,
           list_transform(range({SLOTS}), lambda x: false) AS taken, CAST(NULL AS BIGINT) AS claimed
    UNION ALL
    SELECT turn + CASE WHEN taken[spot + 1] THEN 0 ELSE 1 END,
           list_transform(seen, lambda v, k: CASE WHEN k = turn % {len(SHARDS)} + 1 THEN v + 1 ELSE v END),
           CASE WHEN taken[spot + 1] THEN taken ELSE taken[:spot] || [true] || taken[spot + 2:] END,
           CASE WHEN taken[spot + 1] THEN NULL ELSE spot END
    FROM (SELECT turn, seen, taken,
                 (offsets[turn % {len(SHARDS)} + 1] + seen[turn % {len(SHARDS)} + 1] * skips[turn % {len(SHARDS)} + 1]) % {SLOTS} AS spot
          FROM probes, orders WHERE turn < {SLOTS})),
owners AS (
    SELECT claimed AS slot, name AS shard FROM probes JOIN shards ON i = (turn - 1) % {len(SHARDS)} WHERE claimed IS NOT NULL)
SELECT doc_id, CAST(slot AS INT) AS slot, shard
FROM documents JOIN owners ON slot = {number_sql(row_key_sql("doc_id", "text"))} % {SLOTS}"""


@query
def op5_simhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = simhash.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = simhash.near_components(freeze(prints.select("doc_id", "simhash"), "rows"), radius=3)
    return found.select("doc_id", simhash.as_hex(F.col("simhash")).alias("fingerprint"), "component_id")


MIX_SEED, MIX_ALPHA = 17, 0.5


@query
def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), seed=MIX_SEED, alpha=MIX_ALPHA)


SQL["op6_poisson_mix"] = f"""
WITH sizes AS (
    SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS size FROM documents GROUP BY source),
weighed AS (SELECT *, pow(CAST(size AS DOUBLE), {MIX_ALPHA}) AS weight FROM sizes),
rates AS (
    SELECT source, CASE WHEN size = 0 THEN 1.0 ELSE
        weight / (sum(CASE WHEN size > 0 THEN weight END) OVER ()) * CAST(sum(size) OVER () AS DOUBLE) / size END AS rate
    FROM weighed),
steps AS (
    SELECT source, rate, unnest(range(CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM rates),
terms AS (
    SELECT source, k, exp(k * ln(rate) - rate
        - sum(CASE WHEN k > 0 THEN ln(CAST(k AS DOUBLE)) ELSE 0.0 END) OVER (PARTITION BY source ORDER BY k)) AS p
    FROM steps WHERE rate > 0),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS p FROM terms),
lists AS (SELECT source, list(p) AS ps FROM cdf GROUP BY source),
drawn AS (
    SELECT d.*, len(list_filter(ps, lambda p: p <=
        {number_sql(f"'{MIX_SEED}'", "'copies'", row_key_sql("doc_id", "text"))} / CAST({SPAN} AS DOUBLE))) AS n
    FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
copies AS (SELECT * EXCLUDE (n), CAST(unnest(range(1, n + 1)) AS INT) AS copy FROM drawn)
SELECT *, {number_sql(f"'{MIX_SEED}'", "'order'", row_key_sql("doc_id", "text"), "CAST(copy AS VARCHAR)")} AS mix_key
FROM copies"""


RULES = quality.Rules()


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    counted = freeze(quality.features(documents, RULES).drop("text"), "counts")
    return quality.judge(counted, quality.references(counted, RULES), RULES).drop("lang")


def _quality_sql() -> str:
    words = " ".join(f"WHEN lang = '{name}' THEN {list(common)}" for name, common in RULES.common_words.items())
    classes = ", ".join(
        f"length(t) - length(regexp_replace(t, '[{c}]+', '', 'g'))" for c in (x.replace("'", "''") for x in quality.CLASSES)
    )
    width, count = max(map(len, RULES.common_words.values())), len(quality.CLASSES)

    def jsd(p: str, q: str) -> str:
        def part(a: str, b: str) -> str:
            return f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0.0 END"

        a, b = f"({p}[i] / CAST(list_sum({p}) AS DOUBLE))", f"({q}[i] / CAST(list_sum({q}) AS DOUBLE))"
        terms = f"list_transform(range(1, len({p}) + 1), lambda i: ({part(a, b)} + {part(b, a)}) / 2)"
        return f"round(CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN list_reduce({terms}, lambda x, y: x + y) END, 6)"

    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        CASE {words} END AS common,
        list_filter(string_split(lower(regexp_replace(t, '{quality.BETWEEN}', ' ', 'g')), ' '), lambda x: x <> '') AS parts
    FROM d),
wins AS (
    SELECT rid, unnest(range(1, len(words) - 3)) AS i, unnest(list_transform(range(1, len(words) - 3),
        lambda i: array_to_string(words[i:i + 4], ' '))) AS g FROM w WHERE len(words) >= 5),
twice AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid),
f AS (
    SELECT w.rid, doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
        length(t) AS chars, [{classes}] AS cs,
        CASE WHEN common IS NOT NULL THEN len(parts) END AS compared,
        list_transform(common, lambda x: len(list_filter(parts, lambda y: y = x))) AS ws
    FROM w LEFT JOIN covered c ON c.rid = w.rid),
g AS (
    SELECT *, list_concat(cs, [chars - list_sum(cs)]) AS doc_classes,
        CASE WHEN ws IS NOT NULL THEN list_concat(ws, [compared - list_sum(ws)]) END AS doc_words FROM f),
refs AS (
    SELECT lang AS l, [{", ".join(f"sum(doc_classes[{i + 1}])" for i in range(count + 1))}] AS ref_classes,
        [{", ".join(f"sum(doc_words[{i + 1}])" for i in range(width + 1))}] AS ref_words
    FROM g WHERE lang IS NOT NULL GROUP BY lang),
s AS (
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        n_words < {RULES.min_words} OR 100 * n_repeat_words > {RULES.max_repeat_percent} * n_words AS base_failed,
        CASE WHEN chars >= {RULES.min_chars} THEN {jsd("doc_classes", "ref_classes")} END AS class_divergence,
        CASE WHEN compared >= {RULES.min_compared} THEN {jsd("doc_words", "ref_words")} END AS word_divergence
    FROM g LEFT JOIN refs ON l = lang)
SELECT *, NOT base_failed AND coalesce(class_divergence, 0) <= {RULES.max_class_divergence}
    AND coalesce(word_divergence, 0) <= {RULES.max_word_divergence} AS kept FROM s"""


SQL["op7_quality_rules"] = _quality_sql()


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counter = tokens.share(spark, public_tokenizers.path("word_bpe_49k.json"))
    documents = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return tokens.count_tokens(documents, counter).select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 2048).alias("over_limit"),
    )


@query
def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(documents).select("doc_id", *licences.summary(F.col("hits")))


def _licence_sql(threshold: float = 0.8) -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    rows = ", ".join(
        f"({-k}, {quoted(name)}, {quoted(text)})"
        for k, (name, text) in enumerate((n, t) for n, texts in licences.TEMPLATES.items() for t in texts)
    )
    return rf"""
WITH plain AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_replace(lower(coalesce(text, '')), '{licences.GAP}', ' ', 'g') AS t FROM documents),
blocks AS (SELECT *, regexp_split_to_array(t, '
 *
[ 
]*') AS bs FROM plain),
units AS (
    SELECT rid, unnest(string_split(t, chr(10))) AS u FROM plain
    UNION ALL SELECT rid, u FROM (SELECT rid, unnest(bs) AS u FROM blocks) WHERE contains(u, chr(10))
    UNION ALL SELECT rid, t FROM blocks WHERE len(bs) > 1),
words AS (
    SELECT row_number() OVER () AS uid, rid, list_filter(regexp_split_to_array(u, '[ 
]+'), lambda x: x <> '') AS w FROM units),
grams AS (
    SELECT uid, rid, len(w) - 1 AS n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
    FROM words WHERE len(w) > 1),
counted AS (SELECT uid, rid, n, g, count(*) AS c FROM grams GROUP BY ALL),
templates AS (
    SELECT rank, licence, list_filter(string_split(regexp_replace(lower(text), '{licences.GAP}', ' ', 'g'), ' '), lambda x: x <> '') AS w
    FROM (VALUES {rows}) v(rank, licence, text)),
known AS (
    SELECT rank, licence, len(w) - 1 AS m, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM templates),
known_counted AS (SELECT rank, licence, m, g, count(*) AS c FROM known GROUP BY ALL),
scores AS (
    SELECT uid, rid, rank, licence, 2.0 * CAST(sum(least(a.c, b.c)) AS INT) / (n + m) AS score
    FROM counted a JOIN known_counted b USING (g) GROUP BY uid, rid, rank, licence, n, m),
best AS (
    SELECT rid, uid, max(struct_pack(score := score, rank := rank, licence := licence)) AS b
    FROM scores WHERE score >= {threshold} GROUP BY rid, uid),
docs AS (SELECT rid, max(b) AS b, count(*) AS n_hits FROM best GROUP BY rid)
SELECT doc_id, b.licence AS licence, b.score AS score, coalesce(n_hits, 0) AS n_hits FROM plain LEFT JOIN docs USING (rid)"""


SQL["op9_licence_scan"] = _licence_sql()


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    model = bpe.share(spark, ranks, public_tokenizers.PATTERN)
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return bpe.decode(coded, model).select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


CENTROIDS, ROUNDS, CENTROID_SEED, COMPONENTS, SCALE = 40, 5, 2, 64, 256


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings").where(centroids.usable(F.col("embedding"), COMPONENTS))
    vectors = given.select("vec_id", centroids.whole(F.col("embedding"), SCALE).alias("vector"))
    placed, final = centroids.cluster(vectors, CENTROIDS, ROUNDS, CENTROID_SEED)
    rows = freeze(placed.select("vec_id", "cluster", "distance"), "placed")
    return centroids.with_inertia(rows, final).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _centroids_sql() -> str:
    # x and c hold the components as doubles, which are exact for whole numbers of this size.
    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
    SELECT rid, vec_id, x, b.c AS cluster, b.d AS distance FROM (
        SELECT rid, any_value(vec_id) AS vec_id, any_value(x) AS x, min(struct_pack(
            d := CAST(list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y) AS BIGINT), c := c)) AS b
        FROM v, c{k} GROUP BY rid))"""

    def moved(k: int) -> str:
        return f"""c{k} AS MATERIALIZED (
    SELECT o.c, coalesce(m.y, o.y) AS y FROM c{k - 1} o LEFT JOIN (
        SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS y FROM (
            SELECT cluster, i, CAST(sum(CAST(p AS BIGINT)) AS BIGINT) AS s, count(*) AS n
            FROM (SELECT cluster, unnest(x) AS p, unnest(range({COMPONENTS})) AS i FROM a{k - 1}) GROUP BY cluster, i)
        GROUP BY cluster) m ON m.cluster = o.c)"""

    steps = ",\n".join(f"{assigned(k)},\n{moved(k + 1)}" for k in range(ROUNDS))
    return f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor({SCALE} * CAST(e AS DOUBLE))) AS x
    FROM embeddings WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (
    SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS INT) AS c, x AS y
    FROM (SELECT sha256('{CENTROID_SEED}:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v) ORDER BY h NULLS LAST, x LIMIT {CENTROIDS}),
{steps},
{assigned(ROUNDS)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(distance) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(list_transform(y, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c = cluster"""


SQL["op11_centroids"] = _centroids_sql()


ARITY = 3


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars"]
    turned = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    shortened = F.when(turned, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    rows = documents.select(
        "doc_id",
        "source",
        manifest.leaf([F.col(c) for c in [*columns, "text"]]).alias("digest"),
        manifest.leaf([*[F.col(c) for c in columns], shortened]).alias("tampered"),
    )
    built = manifest.build(rows, "source", ["doc_id"], arity=ARITY)
    return built.leaves.select(
        "doc_id",
        manifest.as_hex(F.col("digest")).alias("leaf"),
        "subroot",
        F.lit(built.root).alias("root"),
        manifest.proof(F.col("path")).alias("proof_sha256"),
        manifest.fold(F.col("tampered"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _manifest_sql() -> str:
    def row(text: str) -> str:
        columns = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in columns) + ")"

    # The bits of a CRC-32 one by one: a byte is taken in, then eight times the lowest bit goes.
    steps = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = (
        f"list_reduce(list_concat([4294967295], {steps}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) "
        "WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    )
    up = f"list_transform(range(0, len(ns), {ARITY}), lambda i: sha256(array_to_string(ns[i + 1:i + {ARITY}], '')))"

    def fold(name: str, start: str, levels: str) -> str:
        return f"""{name} AS (
    {start}
    UNION ALL
    SELECT f.rid, f.s, f.level + 1, f.i // {ARITY}, f.proof || array_to_string(l.ns[r + 1:f.i], '') || array_to_string(l.ns[f.i + 2:r + {ARITY}], ''),
        sha256(array_to_string(l.ns[r + 1:f.i], '') || f.folded || array_to_string(l.ns[f.i + 2:r + {ARITY}], ''))
    FROM (SELECT *, i - i % {ARITY} AS r FROM {name}) f JOIN {levels} l ON l.s IS NOT DISTINCT FROM f.s AND l.level = f.level
    WHERE len(l.ns) > 1)"""

    return rf"""
WITH RECURSIVE d AS (
    SELECT *, {row("text")} AS leaf,
        {row(f"CASE WHEN {crc} % 2 = 1 THEN replace(text, chr(10), '') ELSE text END")} AS tampered FROM documents),
p AS (
    SELECT *, row_number() OVER () AS rid,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
levels AS (
    SELECT source AS s, 0 AS level, list(leaf ORDER BY i) AS ns FROM p GROUP BY source
    UNION ALL SELECT s, level + 1, {up} FROM levels WHERE len(ns) > 1),
subroots AS (
    SELECT s, level AS height, ns[1] AS subroot, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS i FROM levels WHERE len(ns) = 1),
tops AS (
    SELECT 0 AS s, 0 AS level, list(subroot ORDER BY i) AS ns FROM subroots
    UNION ALL SELECT s, level + 1, {up} FROM tops WHERE len(ns) > 1),
{fold("lower", "SELECT rid, source AS s, 0 AS level, i, '' AS proof, tampered AS folded FROM p", "levels")},
{fold("upper", "SELECT l.rid, 0 AS s, 0 AS level, u.i, l.proof, l.folded FROM lower l JOIN subroots u ON u.s IS NOT DISTINCT FROM l.s AND u.height = l.level", "tops")}
SELECT p.doc_id, p.leaf, u.subroot, t.ns[1] AS root, sha256(f.proof) AS proof_sha256, f.folded AS folded_root, f.folded = t.ns[1] AS verified
FROM p JOIN subroots u ON u.s IS NOT DISTINCT FROM p.source JOIN tops t ON len(t.ns) = 1
JOIN upper f ON f.rid = p.rid AND f.level = t.level"""


SQL["op12_merkle_manifest"] = _manifest_sql()


WINDOW = 10


@query
def op13_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontamination.decontaminate(documents, items, window=WINDOW)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


SQL["op13_fm_decontaminate"] = rf"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS big, 'abcdefghijklmnopqrstuvwxyz' AS small),
d AS (
    SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), big, small), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, letters),
i AS (
    SELECT CAST(item_id AS VARCHAR) AS item,
        regexp_extract_all(translate(coalesce(text, ''), big, small), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, letters),
phrases AS (
    SELECT DISTINCT item, least(len(w), {WINDOW}) AS size, unnest(list_transform(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1),
        lambda k: array_to_string(w[k:k + {WINDOW - 1}], ' '))) AS phrase FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM phrases),
places AS (
    SELECT rid, size, unnest(range(1, len(w) - size + 2)) AS spot,
        unnest(list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(w[k:k + size - 1], ' '))) AS phrase
    FROM d, sizes WHERE len(w) >= size),
found AS (SELECT rid, p.size, spot, item FROM places p JOIN phrases q ON p.phrase = q.phrase AND p.size = q.size),
hit AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(spot, spot + size)) AS k FROM found) GROUP BY rid),
named AS (
    SELECT rid, count(DISTINCT item) AS n, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT rid, item FROM found WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)"""
