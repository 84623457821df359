"""The operators of this package as queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustscore.llm import (
    bpe,
    chat,
    collocations,
    decontamination,
    html_templates,
    manifest,
    mixing,
    personal_data,
    quality,
    recipes,
    repeats,
    simhash,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op3_substring_dedup",
    r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    n AS (SELECT doc_id, words, len(words) AS n_words FROM w),
    windows AS (
        SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS content
        FROM (SELECT doc_id, words, unnest(range(1, n_words - 11)) AS pos FROM n)
    ),
    gone AS (
        SELECT doc_id, list(DISTINCT word) AS removed
        FROM (SELECT doc_id, unnest(range(pos, pos + 13)) AS word
              FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY content) AS first FROM windows)
              WHERE first < doc_id)
        GROUP BY doc_id
    ),
    kept AS (
        SELECT n.doc_id, n_words, coalesce(len(removed), 0) AS n_removed,
               list_filter(range(1, n_words + 1), lambda i: removed IS NULL OR NOT list_contains(removed, i)) AS stay, words
        FROM n LEFT JOIN gone USING (doc_id)
    )
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
           sha256(array_to_string(list_transform(stay, lambda i: words[i]), ' ')) AS kept_sha256
    FROM kept
    """,
)
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = repeats.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query(
    "op7_exact_dedup",
    r"""
    WITH n AS (
        SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
    )
    SELECT doc_id, min(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
           doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
    FROM n WINDOW g AS (PARTITION BY body)
    """,
)
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return recipes.exact_groups(table(spark, folder, "documents"))


@query("op8_bpe")
def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = bpe.encode(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    "op2_source_mixing",
    r"""
    WITH sized AS (
        SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
               CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
        FROM documents
    ),
    sources AS (
        SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
               CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
        FROM sized GROUP BY source
    ),
    ordered AS (
        SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM sources
    ),
    levels AS (
        SELECT k, 2 * source_size / weight AS height,
               1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0) AS words,
               sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights
        FROM ordered WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ),
    level AS (SELECT words, weights FROM levels WHERE height >= words / weights ORDER BY k LIMIT 1),
    targets AS (
        SELECT source, source_size, CASE WHEN weight * words > 2 * source_size * weights
                                         THEN 2 * source_size ELSE weight * words / weights END AS target
        FROM sources, level
    ),
    cut AS (
        SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
               coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id NULLS FIRST, size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
        FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
           CAST(whole * size + greatest(0, least(size, round(target - whole * source_size) - earlier)) AS BIGINT) AS taken
    FROM cut
    """,
)
def op2_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query(
    "op10_chat_format",
    r"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ),
    e AS (
        SELECT *, length(text) AS chars, length(role || text)
               + length(role || text) - length(replace(replace(role || text, '<', ''), '[', '')) + 24 AS shown
        FROM c
    )
    SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(sum(CASE WHEN role = 'assistant' THEN chars ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                           FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(shown) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
    """,
)
def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"),
    )
    chats = chat.format_chats(chat.events_of(said.unionByName(added)))
    read = chats.select(
        "conv_id",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("segments")).alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op1_html_extraction")
def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    texts = html_templates.extract(table(spark, folder, "pages"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


@query("op6_personal_data")
def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data.find(table(spark, folder, "documents"))
    order = F.array(*map(F.lit, personal_data.KINDS))

    def listed(spans: Column) -> Column:
        ranked = F.transform(
            spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s.alias("s"))
        )
        shown = F.transform(F.array_sort(ranked), lambda r: F.concat_ws(":", r["s"]["kind"], r["s"]["start"], r["s"]["end"]))
        return F.array_join(shown, ",")

    return found.select(
        "doc_id",
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
    )


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = " || ".join(_FIELD.format(name) for name in ("doc_id", "source", "lang", "n_chars"))


@query(
    "op11_merkle_manifest",
    rf"""
    WITH RECURSIVE d AS (
        SELECT doc_id, source, sha256({_LEAF} || {_FIELD.format("text")}) AS leaf,
               CASE WHEN list_reduce(list_concat([4294967295], list_transform(range(8 * strlen(CAST(doc_id AS VARCHAR))),
                                  lambda i: (ascii(substr(CAST(doc_id AS VARCHAR), i // 8 + 1, 1)) >> (i % 8)) & 1)),
                                lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1))) % 2 = 1
                    THEN sha256({_LEAF} || {_FIELD.format("replace(text, chr(10), '')")}) END AS found
        FROM documents
    ),
    placed AS (
        SELECT *, coalesce('=' || source, '-') AS tree, count(*) OVER (PARTITION BY source) AS n,
               row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos
        FROM d
    ),
    low AS (
        SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed
        UNION ALL
        SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
        FROM low WHERE n > 1 GROUP BY tree, level, pos // 3, n
    ),
    subroots AS (SELECT tree, level AS height, digest FROM low WHERE n = 1),
    high AS (
        SELECT 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, digest FROM subroots
        UNION ALL
        SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
        FROM high WHERE n > 1 GROUP BY level, pos // 3, n
    ),
    places AS (SELECT tree, height, digest, row_number() OVER (ORDER BY tree) - 1 AS place FROM subroots),
    steps AS (
        SELECT a.tree, 0 AS part, a.level, a.pos,
               coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before,
               coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS after
        FROM low a JOIN low b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3
        WHERE a.n > 1 GROUP BY ALL
        UNION ALL
        SELECT '', 1, a.level, a.pos,
               coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), ''),
               coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '')
        FROM high a JOIN high b ON a.level = b.level AND a.pos // 3 = b.pos // 3
        WHERE a.n > 1 GROUP BY ALL
    ),
    walk AS (
        SELECT p.tree, p.pos AS leaf_pos, 0 AS part, 0 AS level, p.pos, s.height, s.place,
               coalesce(p.found, p.leaf) AS own, '' AS proof
        FROM placed p JOIN places s ON p.tree = s.tree
        UNION ALL
        SELECT w.tree, w.leaf_pos, w.part, w.level + 1, w.pos // 3, w.height, w.place,
               sha256(t.before || w.own || t.after), w.proof || t.before || t.after
        FROM (SELECT tree, leaf_pos, CASE WHEN part = 0 AND level = height THEN 1 ELSE part END AS part,
                     CASE WHEN part = 0 AND level = height THEN 0 ELSE level END AS level,
                     CASE WHEN part = 0 AND level = height THEN place ELSE pos END AS pos, height, place, own, proof
              FROM walk) w
        JOIN steps t ON t.tree = CASE WHEN w.part = 0 THEN w.tree ELSE '' END
                    AND t.part = w.part AND t.level = w.level AND t.pos = w.pos
    ),
    folded AS (
        SELECT tree, leaf_pos, arg_max(own, length(proof) + part * 1000000 + level) AS folded_root,
               arg_max(proof, length(proof) + part * 1000000 + level) AS proof
        FROM walk GROUP BY tree, leaf_pos
    )
    SELECT p.doc_id, p.leaf, s.digest AS subroot, (SELECT digest FROM high WHERE n = 1) AS root,
           sha256(f.proof) AS proof_sha256, f.folded_root,
           f.folded_root = (SELECT digest FROM high WHERE n = 1) AS verified
    FROM placed p JOIN places s ON p.tree = s.tree JOIN folded f ON f.tree = p.tree AND f.leaf_pos = p.pos
    """,
)
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    proved = manifest.prove(table(spark, folder, "documents"), F.replace("text", F.lit("\n"), F.lit("")), tampered)
    return proved.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(manifest.proof_text(F.col("path")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_PLAIN_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@query(
    "op12_benchmark_decontamination",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN_WORDS} AS words FROM documents),
    i AS (SELECT item_id, {_PLAIN_WORDS} AS words FROM benchmark),
    item_windows AS (
        SELECT DISTINCT item_id, span, array_to_string(words[pos:pos + span - 1], ' ') AS content
        FROM (SELECT item_id, words, least(10, len(words)) AS span, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS pos
              FROM i WHERE len(words) > 0)
    ),
    hits AS (
        SELECT r, pos, t.span, item_id
        FROM (SELECT r, span, pos, array_to_string(words[pos:pos + span - 1], ' ') AS content
              FROM (SELECT r, words, span, unnest(range(1, len(words) - span + 2)) AS pos
                    FROM d, (SELECT DISTINCT span FROM item_windows) WHERE len(words) >= span)) t
        JOIN item_windows w ON w.span = t.span AND w.content = t.content
    ),
    inside AS (
        SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(pos, pos + span)) AS word FROM hits) GROUP BY r
    ),
    items AS (
        SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
    )
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN inside USING (r) LEFT JOIN items USING (r)
    """,
)
def op12_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(
    "op13_phrase_collocations",
    r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ),
    split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
    grams AS (
        SELECT lang, size, array_to_string(words[pos:pos + size - 1], ' ') AS phrase
        FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS pos
              FROM split, (SELECT unnest([1, 2, 3]) AS size) WHERE len(words) >= size)
    ),
    f AS (SELECT lang, size, phrase, count(*) AS f, string_split(phrase, ' ') AS words FROM grams GROUP BY lang, size, phrase),
    total AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
    candidates AS (SELECT * FROM f WHERE size > 1 AND f >= 10),
    cuts AS (
        SELECT c.lang, c.phrase, c.f AS a, c.size, k, l.f AS l, r.f AS r,
               (CAST(1000000 AS HUGEINT) * c.f * c.f) // (CAST(l.f AS HUGEINT) * r.f) AS score
        FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
        JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:k], ' ')
        JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[k + 1:], ' ')
    ),
    lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    covered AS (
        SELECT DISTINCT s.lang, s.phrase
        FROM candidates s JOIN (SELECT lang, f, array_to_string(words[pos:pos + 1], ' ') AS phrase
                                FROM (SELECT *, unnest([1, 2]) AS pos FROM candidates WHERE size = 3)) b
          ON s.lang = b.lang AND s.phrase = b.phrase
        WHERE 100 * b.f >= 50 * s.f
    ),
    ranked AS (
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
        FROM lowest ANTI JOIN covered USING (lang, phrase)
    )
    SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
           CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM ranked JOIN total USING (lang) WHERE rank <= 2000
    """,
)
def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))
