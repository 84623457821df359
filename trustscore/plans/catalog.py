"""Every operator as a query over the given tables, next to the SQL that must give the same rows.

Texts enter whole. Wide or nested results are reported through digests and counts of all rows, never
through a subset. Real numbers are rounded on both sides because sums are taken in another order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustscore import constants as C
from trustscore.functions import numbers, text
from trustscore.operators import (
    assembly,
    behavior_signal,
    diagnosis,
    diagnosis_join,
    evaluation,
    labelled,
    meta,
    model,
    network_signal,
    similarity_sums,
    text_signal,
    validation,
)
from trustscore.operators.reasons import codes
from trustscore.plans.analysis import analyze_flat, analyze_reviews, rejected_reviews
from trustscore.plans.views import Tables
from trustscore.session import materialized, shared_folder
from trustscore.sources import readers, writers
from trustscore.streaming import events as stream_events
from trustscore.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def r6(value: Column | str) -> Column:
    return F.round(value, 6)


def big(value: Column) -> Column:
    return value.cast("bigint")


def joined(values: Column | str) -> Column:
    return F.concat_ws("|", values)


# --- SQL fragments ------------------------------------------------------------------------------

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sql_space(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x},''), '{WS}', ' ', 'g'))"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


def sql_fold(x: str) -> str:
    return f"replace(lower({x}),'ß','ss')"


def sql_norm(x: str) -> str:
    return sql_fold(sql_space(x))


def sql_canon(x: str) -> str:
    return rf"regexp_replace({sql_fold(f'coalesce({x},{chr(39)*2})')}, '[^\p{{L}}\p{{N}}]', '', 'g')"


def sql_count(x: str, word: str) -> str:
    return f"((length({x}) - length(replace({x}, '{word}', ''))) // {len(word)})"


def sql_round1(x: str) -> str:
    return f"cast(printf('%.1f', {x}) as double)"


def sql_level(x: str) -> str:
    return f"case when {x} >= 70 then 'safe' when {x} >= 40 then 'warn' when {x} is not null then 'danger' end"


TEXTS = """texts as (select 'd-' || doc_id as id, text from documents
  union all select 'c-' || conv_id || '-' || turn, text from conversations)"""
REVIEWS = """reviews as (select cast(doc_id as varchar) as review_id, source as product_id, 'web' as platform,
  text as content, doc_id as row_no from documents)"""
MASTER = """master as (select d.doc_id as row_no, d.doc_id || '.0' as master_id, source as platform, text as review,
  case when toxic = 1 then ' suspicious ' when quality = 1 then 'Normal' else 'UNCERTAIN' end as final_label,
  lang || ' 상세 페이지' as collection_reason,
  case when n_chars > 2000 then '다른 리뷰와 유사' when n_chars > 1000 then '개인 경험 없음' end as note,
  upper(lang) as use_for_training, n_chars from documents d join labels using (doc_id))"""
SELECTED = (
    MASTER
    + f""",
selected as (select row_no, {sql_strip('review')} as text, case trim(upper(final_label)) when 'NORMAL' then 0 when 'SUSPICIOUS' then 1 end as label
  from master where trim(upper(final_label)) in ('NORMAL','SUSPICIOUS') and {sql_strip('review')} <> ''),
grouped as (select {sql_norm('text')} as norm, min_by(text, row_no) as text, min(row_no) as row_no, min(label) as label,
  max(label) as top_label, min_by(label, row_no) as own_label, count(*) as n from selected group by 1),
examples as (select norm, text, row_no, label from grouped where label = top_label)"""
)
SPLITS = (
    SELECTED
    + """,
sized as (select *, count(*) over (partition by label) as n_class,
  row_number() over (partition by label order by md5('42|' || norm)) as rn from examples),
splits as (select norm, text, row_no, label, case when rn <= n_class - 2*h then 'train' when rn <= n_class - h then 'validation' else 'test' end as split
  from (select *, greatest(1, cast(round_even(n_class * 0.1::double, 0) as bigint)) as h from sized))"""
)
DIAGNOSES = """diagnoses as (select row_no, master_id, platform, review, collection_reason, note,
  case when n_chars < 1000 then 'TEXT_STRONG' when n_chars < 2500 then 'TEXT_WEAK' else 'NETWORK_STRONG' end as diagnostic_type
  from master where trim(final_label) = 'suspicious')"""
SCORED = SPLITS + """,
scored as (select *, (row_no*37 % 101)/100.0::double as probability from splits)"""


def scored_splits(t: Tables) -> DataFrame:
    splits = labelled.stratified_split(labelled.prepare_examples(labelled.select_labelled(t.master())))
    return splits.withColumn("probability", (F.col("row_no") * 37) % 101 / 100.0)


def selected_rows(t: Tables) -> DataFrame:
    return labelled.select_labelled(t.master())


# --- 2.1 sources and sinks ----------------------------------------------------------------------


def _crawled(t: Tables) -> DataFrame:
    """Documents as collected reviews; short ones lack content, French ones an image list."""
    return t.documents().select(
        F.lit("web").alias("platform"),
        F.col("source").alias("product_id"),
        F.col("doc_id").cast("string").alias("review_id"),
        F.when(F.col("n_chars") >= 300, F.col("text")).alias("content"),
        F.lit(5.0).alias("rating"),
        F.col("lang").alias("author"),
        F.timestamp_seconds("doc_id").alias("written_at"),
        F.lit(None).cast("string").alias("option"),
        F.when(F.col("lang") != "fr", F.array("source")).alias("images"),
        F.lit(None).cast("int").alias("helpful_count"),
        F.lit(None).cast("timestamp").alias("collected_at"),
    )


@query(
    "S1_read_reviews",
    """select source as product_id, cast(count(*) filter (n_chars >= 300) as bigint) as usable,
  cast(count(*) filter (n_chars < 300) as bigint) as rejected,
  cast(coalesce(sum(case when lang <> 'fr' then 1 else 0 end) filter (n_chars >= 300),0) as bigint) as images
from documents group by 1""",
)
def s1(t: Tables) -> DataFrame:
    """Written as JSON lines with an unknown key and read back through the reader."""
    path = f"{shared_folder(t.spark)}/reviews-{pd.Timestamp.now().value}"
    _crawled(t).withColumn("unknown_key", F.lit(1)).write.json(path)
    good, rejected = readers.read_reviews(t.spark, path)
    rows = good.select("product_id", F.lit(1).alias("good"), F.size("images").alias("images")).unionByName(
        rejected.select("product_id", F.lit(0).alias("good"), F.lit(0).alias("images"))
    )
    return rows.groupBy("product_id").agg(
        F.count_if(F.col("good") == 1).alias("usable"),
        F.count_if(F.col("good") == 0).alias("rejected"),
        F.sum("images").alias("images"),
    )


@query(
    "S2_read_review_master",
    f"with {MASTER} select final_label, count(*) as rows, sum(length(review))::bigint as characters from master group by 1",
)
def s2(t: Tables) -> DataFrame:
    padded = t.master().select(F.col("review").alias(" review"), F.col("final_label").alias("final_label "))
    path = f"{shared_folder(t.spark)}/master-{uuid.uuid4().hex}"
    writers.write_new(padded, path, "json")
    return readers.read_review_master(t.spark, path, "json").groupBy("final_label").agg(
        F.count("*").alias("rows"), F.sum(F.length("review")).alias("characters")
    )


@query(
    "S3_read_labelling",
    f"with {MASTER} select final_label, use_for_training, count(*) as rows from master group by 1, 2",
)
def s3(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/labelling-{uuid.uuid4().hex}"
    writers.write_new(t.master().withColumnRenamed("review", " content "), path, "json")
    rows = readers.read_labelling(t.spark, path, "json")
    return rows.groupBy("final_label", "use_for_training").agg(F.count("content").alias("rows"))


@query(
    "S4_load_diagnoses",
    f"with {MASTER}, {DIAGNOSES} select cast(row_no as varchar) as master_id, diagnostic_type, md5({sql_strip('review')}) as review from diagnoses",
)
def s4(t: Tables) -> DataFrame:
    return readers.load_diagnoses(t.diagnoses()).select("master_id", "diagnostic_type", F.md5("review").alias("review"))


@query(
    "S5_load_diagnoses_by_text",
    f"""with {MASTER}, {DIAGNOSES} select md5({sql_norm('review')}) as norm, min_by(master_id, row_no) as master_id,
  min_by(diagnostic_type, row_no) as diagnostic_type, count(*) as rows from diagnoses group by 1""",
)
def s5(t: Tables) -> DataFrame:
    return readers.load_diagnoses_by_text(t.diagnoses()).select(
        F.md5(text.normalize_text("review")).alias("norm"), "master_id", "diagnostic_type", "rows"
    )


@query(
    "S6_load_suspicious",
    f"""with {MASTER} select master_id, platform, md5({sql_space('review')}) as review, collection_reason,
  coalesce(note, '') as note from master where upper(trim(final_label)) = 'SUSPICIOUS'""",
)
def s6(t: Tables) -> DataFrame:
    return readers.load_suspicious(t.master()).select(
        "master_id", "platform", F.md5("review").alias("review"), "collection_reason", F.col(C.NOTE_COLUMN).alias("note")
    )


@query("S7_write_new", f"with {MASTER}, {DIAGNOSES} select diagnostic_type, count(*) as rows, sum(length(review))::bigint as characters from diagnoses group by 1")
def s7(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/diagnoses-{pd.Timestamp.now().value}.csv"
    writers.write_new(readers.load_diagnoses(t.diagnoses()).select("master_id", "review", "diagnostic_type"), path, "csv")
    back = t.spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    return back.groupBy("diagnostic_type").agg(F.count("*").alias("rows"), F.sum(F.length("review")).alias("characters"))


def _sources(t: Tables) -> list[assembly.Source]:
    """Three reviewed sources over the labelled documents, as the assembly expects them."""
    master = t.master()
    exact = F.upper(F.trim("final_label"))
    blanked = F.when(F.col("n_chars") > 400, F.col("review")).otherwise("  ")
    approved = F.when(F.col("n_chars") > 800, " yes").otherwise("no")
    baseline = master.select("row_no", "master_id", blanked.alias("review"), exact.alias("final_label"))
    recheck = master.select(
        "row_no", F.lit(" ").alias("master_id"), "review", exact.alias("new_final_label"), approved.alias("use_for_training")
    )
    merged = master.select(
        "row_no", F.col("row_no").alias("source_excel_row"), blanked.alias("content"), F.col("final_label"),
        F.lit("YES").alias("use_for_training"),
    )
    return [
        assembly.Source("baseline_normal", baseline, "REVIEW_MASTER", "review", "final_label", "master_id", False),
        assembly.Source("existing_rechecked", recheck, "recheck", "review", "new_final_label", "master_id", True),
        assembly.Source("merged_rechecked", merged, "labeling", "content", "final_label", "source_excel_row", True),
    ]


SOURCES_SQL = (
    MASTER
    + """,
raw as (
  select 'baseline_normal' as source_set, 'REVIEW_MASTER' as sheet, row_no, master_id as id, case when n_chars > 400 then review else '  ' end as content,
    upper(trim(final_label)) as label, upper(trim(final_label)) = 'NORMAL' as ok from master
  union all select 'existing_rechecked', 'recheck', row_no, ' ', review, upper(trim(final_label)),
    upper(trim(final_label)) in ('NORMAL','SUSPICIOUS') and n_chars > 800 from master
  union all select 'merged_rechecked', 'labeling', row_no, cast(row_no as varchar), case when n_chars > 400 then review else '  ' end,
    final_label, final_label in ('NORMAL','SUSPICIOUS') from master)"""
)
ASSEMBLED_SQL = (
    SOURCES_SQL
    + """,
assembled as (select source_set, case when trim(id) = '' then sheet || ':' || (row_no + 2) else id end as source_id, content,
  label as final_label, source_set || '; sheet=' || sheet || '; row=' || (row_no + 2) as source_note from raw where ok and trim(content) <> '')"""
)


@query("S8_publish", f"with {ASSEMBLED_SQL} select source_set, count(*) as rows, sum(length(content))::bigint as characters from assembled group by 1")
def s8(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/assembled-{pd.Timestamp.now().value}"
    writers.publish(assembly.assemble(_sources(t)), path, inputs=(t.folder,))
    return t.spark.read.parquet(path).groupBy("source_set").agg(
        F.count("*").alias("rows"), F.sum(F.length("content")).alias("characters")
    )


METRIC_COLUMNS = ["tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1", "suspicious_precision", "suspicious_recall", "suspicious_f1"]


def sql_metrics(cells: str, extra: str = "") -> str:
    """Metrics over a relation with tn, fp, fn, tp."""
    return f"""rates as (select *, coalesce(tn/nullif(tn+fn,0),0)::double as np, coalesce(tn/nullif(tn+fp,0),0)::double as nr,
  coalesce(tp/nullif(tp+fp,0),0)::double as sp, coalesce(tp/nullif(tp+fn,0),0)::double as sr from {cells}),
metrics as (select {extra} tn, fp, fn, tp, (tn+tp)/(tn+fp+fn+tp) as accuracy, (np+sp)/2 as precision, (nr+sr)/2 as recall,
  (coalesce(2*np*nr/nullif(np+nr,0),0) + coalesce(2*sp*sr/nullif(sp+sr,0),0))/2 as f1, sp as suspicious_precision,
  sr as suspicious_recall, coalesce(2*sp*sr/nullif(sp+sr,0),0) as suspicious_f1 from rates)"""


def rounded_metrics(rows: DataFrame, *first: str) -> DataFrame:
    return rows.select(*first, *METRIC_COLUMNS[:4], *[r6(name).alias(name) for name in METRIC_COLUMNS[4:]])


ROUNDED_SQL = ", ".join(METRIC_COLUMNS[:4] + [f"round({name}, 6) as {name}" for name in METRIC_COLUMNS[4:]])
CELLS_SQL = """count(*) filter (label=0 and predicted=0)::bigint as tn, count(*) filter (label=0 and predicted=1)::bigint as fp,
  count(*) filter (label=1 and predicted=0)::bigint as fn, count(*) filter (label=1 and predicted=1)::bigint as tp"""
E1_SQL = f"""with {SCORED}, cells as (select {CELLS_SQL} from (select label, (probability >= 0.5)::int as predicted from scored)),
{sql_metrics('cells')} select {ROUNDED_SQL} from metrics"""


@query("S9_write_metrics", E1_SQL)
def s9(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/metrics-{pd.Timestamp.now().value}"
    metrics = evaluation.classification_metrics(
        scored_splits(t).select("label", (F.col("probability") >= 0.5).cast("int").alias("predicted"))
    )
    writers.write_metrics(metrics, path)
    return rounded_metrics(t.spark.read.json(path))


def _flat_stub(t: Tables) -> DataFrame:
    """Public rows with text scores only."""
    rows = t.reviews().join(t.probabilities().select("review_id", "suspicious_probability"), "review_id")
    return meta.to_flat(
        meta.meta_score(
            text_signal.text_score(rows).withColumns(
                {"behavior_score": F.lit(None).cast("double"), "network_score": F.lit(None).cast("double")}
            )
        )
    )


TEXT_FLAT = f"""{REVIEWS}, flat as (select *, round_even((1 - p)*100, 0) as text_score from
  (select *, (row_no*37 % 101)/100.0::double as p from reviews))"""


@query(
    "S10_product_response",
    f"""with {TEXT_FLAT}
select p.platform, p.product_id, c.n as review_count, page, md5(ids) as ids, round(scores, 6) as scores, p.n as entries from (
  select platform, product_id, ((rn - 1) // 20)::int as page, string_agg(review_id, '|' order by row_no) as ids, sum(text_score) as scores, count(*) as n
  from (select *, row_number() over (partition by product_id order by row_no) as rn from flat) group by 1, 2, 3) p
join (select product_id, count(*) as n from flat group by 1) c using (product_id)""",
)
def s10(t: Tables) -> DataFrame:
    pages = writers.to_product_response(_flat_stub(t), page_size=20)
    ids = F.transform("results", lambda item: item["review_id"])
    total = F.aggregate(F.transform("results", lambda item: item["text_score"]), F.lit(0.0), lambda a, b: a + b)
    return pages.select(
        "platform", "product_id", "review_count", "page", F.md5(joined(ids)).alias("ids"), r6(total).alias("scores"),
        big(F.size("results")).alias("entries"),
    )


@query(
    "S11_limit_per_product",
    f"with {REVIEWS} select product_id, review_id from reviews qualify row_number() over (partition by platform, product_id order by row_no) <= 7",
)
def s11(t: Tables) -> DataFrame:
    return readers.limit_per_product(t.reviews(), 7).select("product_id", "review_id")


# --- 2.2 keys, mapping, validation --------------------------------------------------------------


@query("P1_scoped_key", f"with {REVIEWS} select platform || ':' || review_id as key, platform || ':' || product_id as product_key from reviews")
def p1(t: Tables) -> DataFrame:
    return t.reviews().select(
        validation.scoped_key("platform", "review_id").alias("key"),
        validation.scoped_key("platform", "product_id").alias("product_key"),
    )


@query(
    "P2_mixed_batches",
    """select lang, count(distinct 'web:' || source) as origin_count, min('web:' || source) as first_origin from documents
group by 1 having count(distinct source) > 1""",
)
def p2(t: Tables) -> DataFrame:
    rows = t.documents().select("lang", F.lit("web").alias("platform"), F.col("source").alias("product_id"))
    return validation.mixed_batches(rows, "lang")


@query("P2_resolve_product_key", "select 'web:' || source as product_key, count(*) as rows from documents group by 1")
def p2b(t: Tables) -> DataFrame:
    keyed = validation.resolve_product_key(t.reviews().withColumn("batch", F.col("product_id")), batch="batch")
    return keyed.groupBy("product_key").agg(F.count("*").alias("rows"))


@query(
    "P3_to_analysis_inputs",
    """select 'web:' || doc_id as review_id, 'web:' || source as product_id, md5(text) as content, to_timestamp(doc_id)::timestamp as review_date,
  true as nothing_invented from documents where n_chars >= 300""",
)
def p3(t: Tables) -> DataFrame:
    good, _ = readers.split_required(_crawled(t))
    inputs = validation.to_analysis_inputs(good.withColumn("product_key", validation.scoped_key("platform", "product_id")))
    absent = reduce(lambda a, b: a & b, [F.col(name).isNull() for name in validation.UNOBSERVED])
    return inputs.select("review_id", "product_id", F.md5("content").alias("content"), "review_date", absent.alias("nothing_invented"))


@query(
    "P4_inputs_from_rows",
    """select cast(doc_id as varchar) as review_id, 'all' as product_id, case when n_chars >= 300 then length(text) else 0 end::bigint as characters,
  to_timestamp(doc_id)::timestamp as review_date from documents""",
)
def p4(t: Tables) -> DataFrame:
    rows = _crawled(t).drop("product_id").withColumn("review_id", F.col("review_id").cast("bigint"))
    return validation.to_inputs_from_rows(rows, "web", "all").select(
        "review_id", "product_id", big(F.length("content")).alias("characters"), "review_date"
    )


@query(
    "P5_validate_inputs",
    """with rows as (select case when lang = 'es' then ' ' else source end as product_id, case when n_chars < 200 then '' else cast(n_chars as varchar) end as review_id from documents),
counted as (select product_id, review_id, count(*) as n from rows group by 1, 2)
select product_id, review_id, 'blank_product_id' as violation, n as rows from counted where trim(product_id) = ''
union all select product_id, review_id, 'blank_review_id', n from counted where trim(review_id) = ''
union all select product_id, review_id, 'duplicate_review_id', n from counted where n > 1 and trim(review_id) <> ''""",
)
def p5(t: Tables) -> DataFrame:
    rows = t.documents().select(
        F.when(F.col("lang") == "es", " ").otherwise(F.col("source")).alias("product_id"),
        F.when(F.col("n_chars") < 200, "").otherwise(F.col("n_chars").cast("string")).alias("review_id"),
    )
    return validation.validate_inputs(rows)


def _public_rows(t: Tables) -> DataFrame:
    """Event values as public scores, some outside the contract, some contradicting each other."""
    value = F.col("value")
    return t.events().select(
        F.col("event_id").cast("string").alias("review_id"),
        F.when(value > 300, float("nan")).when(value < 5, -1.0).otherwise(value).alias("rti"),
        F.when(value < 20, -1.0).otherwise(value / 2).alias("text_score"),
        F.lit(-1.0).alias("behavior_score"),
        F.when(value > 150, None).otherwise(-1.0).alias("network_score"),
        F.when(value >= 60, "safe").when(value >= 40, "warn").when(value >= 5, "danger").alias("level"),
    )


PUBLIC_SQL = """public as (select cast(event_id as varchar) as review_id, case when value > 300 then 'nan'::double when value < 5 then -1.0 else value end as rti,
  case when value < 20 then -1.0 else value/2 end as text_score, -1.0 as behavior_score, case when value > 150 then null else -1.0 end as network_score,
  case when value >= 60 then 'safe' when value >= 40 then 'warn' when value >= 5 then 'danger' end as level from events)"""


@query(
    "P6_validate_scores",
    f"with {PUBLIC_SQL} "
    + " union all ".join(
        f"""select review_id, '{name}' as "column" from public where {name} is null or isnan({name}) or not ({name} = -1 or {name} between 0 and 100)"""
        for name in validation.SCORE_COLUMNS
    ),
)
def p6(t: Tables) -> DataFrame:
    return validation.validate_scores(_public_rows(t))


@query(
    "P7_validate_contract",
    f"""with {PUBLIC_SQL}
select review_id, 'rti_availability' as violation from public
where isnan(rti) or network_score is null or (rti = -1) <> (text_score = -1 and behavior_score = -1 and network_score = -1)
union all select review_id, 'level' from public where level is distinct from case when rti = -1 or isnan(rti) then null else {sql_level('rti')} end""",
)
def p7(t: Tables) -> DataFrame:
    return validation.validate_contract(_public_rows(t))


@query(
    "P8_select_labelled",
    f"with {SELECTED} select row_no, label, md5(text) as text from selected where row_no in (select row_no from master where lower(use_for_training) = 'en')",
)
def p8(t: Tables) -> DataFrame:
    rows = labelled.select_labelled(t.master(), flag_column="use_for_training", flag_value=" En ")
    return rows.select("row_no", "label", F.md5("text").alias("text"))


# --- 2.3 scalar functions -----------------------------------------------------------------------


def over_texts(sql: str) -> str:
    return f"with {TEXTS} select id, {sql} from texts"


@query("F1_normalize_text", over_texts(f"md5({sql_norm('text')}) as value"))
def f1(t: Tables) -> DataFrame:
    return t.texts().select("id", F.md5(text.normalize_text("text")).alias("value"))


@query("F2_normalized", over_texts(f"md5({sql_space('text')}) as value"))
def f2(t: Tables) -> DataFrame:
    return t.texts().select("id", F.md5(text.collapse_spaces("text")).alias("value"))


@query("F3_canonical_text", over_texts(f"md5({sql_canon('text')}) as value"))
def f3(t: Tables) -> DataFrame:
    return t.texts().select("id", F.md5(text.canonical_text("text")).alias("value"))


@query("F4_is_informative", over_texts(f"length({sql_canon('text')}) >= 10 as value"))
def f4(t: Tables) -> DataFrame:
    return t.texts().select("id", text.is_informative(text.canonical_text("text")).alias("value"))


CHARS_SQL = f"""canon as (select id, {sql_canon('text')} as c from texts),
chars as (select id, unnest(string_split(c, '')) as ch, unnest(range(1, length(c) + 1)) as pos from canon where c <> ''),
spans as (select id, pos, ch || lead(ch) over w as g2, ch || lead(ch) over w || lead(ch, 2) over w as g3,
  ch || lead(ch) over w || lead(ch, 2) over w || lead(ch, 3) over w as g4 from chars window w as (partition by id order by pos)),
grams as (select id, g2 as term from spans where g2 is not null union all select id, g3 from spans where g3 is not null
  union all select id, g4 from spans where g4 is not null)"""


@query(
    "F5_ngrams",
    f"""with {TEXTS}, {CHARS_SQL} select id, count(*) as grams, count(distinct term) as terms, min(term) as first_term, max(term) as last_term
from grams group by 1""",
)
def f5(t: Tables) -> DataFrame:
    grams = text.ngrams("characters")
    # Texts with a gram are told by their length: a condition on the grams would be moved below them and make them twice.
    canonical = network_signal.spread(t.texts(), "id").withColumn("canonical", text.canonical_text("text"))
    long_enough = canonical.filter(F.length("canonical") >= min(C.NGRAM_SIZES))
    rows = long_enough.withColumn("characters", text.characters("canonical")).select("id", grams.alias("g"))
    return rows.select(
        "id", big(F.size("g")).alias("grams"), big(F.size(F.array_distinct("g"))).alias("terms"),
        F.array_min("g").alias("first_term"), F.array_max("g").alias("last_term"),
    )


WORDS = ("stupid", "the", "een", "tion", "êê", "최고", "좋아요")


@query(
    "F6_keyword_counts",
    over_texts(
        "concat_ws('|', " + ", ".join(f"case when {sql_count('text', w)} >= 2 then '{w}=' || {sql_count('text', w)} end" for w in sorted(WORDS)) + ") as value"
    ),
)
def f6(t: Tables) -> DataFrame:
    counts = text.keyword_counts("text", sorted(WORDS))
    listed = F.transform(F.map_entries(counts), lambda entry: F.concat_ws("=", entry["key"], entry["value"].cast("string")))
    return t.texts().select("id", joined(listed).alias("value"))


@query("F7_exclamations_and_length", over_texts(f"{sql_count('text', '!')}::bigint as exclamations, length({sql_strip('text')})::bigint as characters"))
def f7(t: Tables) -> DataFrame:
    return t.texts().select(
        "id", big(text.occurrences("text", "!")).alias("exclamations"), big(F.length(text.strip("text"))).alias("characters")
    )


@query(
    "F8_rounding",
    f"select event_id, {sql_round1('value')} as one, {sql_round1('value / 7')} as seventh, round_even(value, 0) as whole, round_even((1 - (event_id % 101)/100.0::double) * 100, 0) as score from events",
)
def f8(t: Tables) -> DataFrame:
    probability = F.col("event_id") % 101 / 100.0
    return t.events().select(
        "event_id",
        numbers.round_one(F.col("value")).alias("one"),
        numbers.round_one(F.col("value") / 7).alias("seventh"),
        numbers.round_whole(F.col("value")).alias("whole"),
        text_signal.score_of_probability(probability).alias("score"),
    )


@query("F9_master_id", r"select event_id, regexp_replace(trim(case when value > 50 then ' ' || event_id || '.0 ' when value > 20 then event_id || '.5' else event_id || 'a.0' end), '^(\d+)\.0$', '\1') as value from events")
def f9(t: Tables) -> DataFrame:
    key = F.col("event_id").cast("string")
    raw = (
        F.when(F.col("value") > 50, F.concat(F.lit(" "), key, F.lit(".0 ")))
        .when(F.col("value") > 20, F.concat(key, F.lit(".5")))
        .otherwise(F.concat(key, F.lit("a.0")))
    )
    return t.events().select("event_id", text.master_id(raw).alias("value"))


@query(
    "F10_abbreviate",
    over_texts(
        f"md5(case when length(text) > 180 then substr(text, 1, 179) || '…' else text end) as plain, "
        f"md5(case when length({sql_space('text')}) > 180 then substr({sql_space('text')}, 1, 179) || '…' else {sql_space('text')} end) as compact"
    ),
)
def f10(t: Tables) -> DataFrame:
    return t.texts().select(
        "id", F.md5(text.abbreviate("text")).alias("plain"), F.md5(text.abbreviate("text", collapse=True)).alias("compact")
    )


CREATED_SQL = """created as (select user_id, min(ts) as created_at from events where event_type = 'signup' group by 1),
inputs as (select cast(event_id as varchar) as review_id, e.user_id, ts, case when event_type = 'purchase' then true when event_type <> 'error' then false end as verified,
  created_at, trunc(value)::bigint as m1, trunc(value * 2)::bigint as m2 from events e left join created using (user_id)),
aged as (select *, date_diff('day', created_at::date, ts::date) as age from inputs)"""


@query("F11_account_age", f"with {CREATED_SQL} select review_id, case when age >= 0 then age end::int as account_age_days, coalesce(age < 0, false) as created_after from aged")
def f11(t: Tables) -> DataFrame:
    return behavior_signal.account_age_days(t.behavior_inputs()).select(
        "review_id", "account_age_days", F.col("account_created_after_review").alias("created_after")
    )


@query("F12_scaling", "select event_id, round(least(1, greatest(0, (value/100 - 0.5)/0.5)), 6) as scaled, round(1 - exp(-value/2), 6) as saturated from events")
def f12(t: Tables) -> DataFrame:
    return t.events().select(
        "event_id",
        r6(numbers.above_floor(F.col("value") / 100, 0.5)).alias("scaled"),
        r6(numbers.saturation(F.col("value"))).alias("saturated"),
    )


PATTERNS = (r"st[ou]pid|worthless", r"(?:tion|ment)\s*(?:the|de).{0,12}(?:on|en)", r"[0-9]{3,}", r"é.{0,3}ê", r"^[^\n.!?]{2,40}(?:is|le)\s+[^\n.!?]{5,}")


@query(
    "F13_patterns",
    over_texts(
        " or ".join(f"regexp_matches(text, '(?i){p}')" for p in PATTERNS)
        + " as matches, ("
        + " + ".join(f"regexp_matches(text, '(?i){p}')::bigint" for p in PATTERNS)
        + ") as hits"
    ),
)
def f13(t: Tables) -> DataFrame:
    return t.texts().select(
        "id", text.matches_any("text", PATTERNS).alias("matches"), big(text.matching_count("text", PATTERNS)).alias("hits")
    )


# --- 2.4 text signal ----------------------------------------------------------------------------

RULE_WORDS = ("the", "stupid", "les")


def sql_rules(x: str) -> dict[str, str]:
    hits = {w: f"({sql_count(x, w)} >= 2)" for w in RULE_WORDS}
    short, loud = f"(length({sql_strip(x)}) < 20)", f"({sql_count(x, '!')} >= 3)"
    penalty = " + ".join([f"15*{h}::int" for h in hits.values()] + [f"25*{short}::int", f"10*{loud}::int"])
    reasons = ", ".join(
        [f"case when {h} then 'REPETITIVE_KEYWORD' end" for h in hits.values()]
        + [f"case when {short} then 'SHORT_REVIEW' end", f"case when {loud} then 'EXCESSIVE_EXCLAMATION' end"]
    )
    return {"penalty": penalty, "reasons": reasons}


RULES = sql_rules("text")


@query("T1_text_rules", over_texts(f"greatest(0, 100 - ({RULES['penalty']}))::double as score, concat_ws('|', {RULES['reasons']}) as reasons"))
def t1(t: Tables) -> DataFrame:
    ruled = text_signal.text_rules(t.texts().withColumnRenamed("text", "content"), RULE_WORDS)
    return ruled.select("id", F.col("text_rule_score").alias("score"), joined(codes("text_reasons")).alias("reasons"))


@query(
    "T2_sentiment",
    over_texts(
        f"""greatest(0, 100 - ({RULES['penalty']}) - case when length(text) > 1500 and length(text) < 4000 then 5 else 0 end)::double as score,
concat_ws('|', {RULES['reasons']}, case when length(text) > 1500 and length(text) < 4000 then 'OVERLY_POSITIVE_SENTIMENT' end) as reasons"""
    ),
)
def t2(t: Tables) -> DataFrame:
    size = F.length("text")
    sentiment = t.texts().filter(size > 100).select(
        "id",
        F.when(size < 4000, "available").otherwise("unavailable").alias("status"),
        F.when(size > 500, 0.9).otherwise(0.8).alias("score"),
        F.when(size > 1500, 1.6).otherwise(1.5).alias("magnitude"),
    )
    ruled = text_signal.text_rules(t.texts().withColumnRenamed("text", "content"), RULE_WORDS)
    rows = text_signal.with_sentiment(ruled, sentiment, "id")
    return rows.select("id", F.col("text_rule_score").alias("score"), joined(codes("text_reasons")).alias("reasons"))


@query(
    "T3_text_score",
    f"""with {REVIEWS} select review_id, round_even((1 - p)*100, 0) as text_score, case when p >= 0.3 then 'SUSPICIOUS' else 'NORMAL' end as predicted_label
from (select *, (row_no*37 % 101)/100.0::double as p from reviews)""",
)
def t3(t: Tables) -> DataFrame:
    return text_signal.text_score(t.probabilities(), threshold=0.3).select("review_id", "text_score", "predicted_label")


def _faulty_probabilities(t: Tables) -> DataFrame:
    """Every seventh probability lies above one, every eleventh is no number, every thirteenth is missing."""
    number, given = F.col("row_no"), F.col("suspicious_probability")
    return t.probabilities().withColumn(
        "suspicious_probability",
        F.when(number % 7 == 3, given + 1.01)
        .when(number % 11 == 5, float("nan"))
        .when(number % 13 == 7, None)
        .otherwise(given),
    )


@query(
    "T3_probability_violations",
    f"with {REVIEWS} select review_id, row_no % 7 = 3 as above from reviews where row_no % 7 = 3 or row_no % 11 = 5",
)
def t3b(t: Tables) -> DataFrame:
    found = text_signal.probability_violations(_faulty_probabilities(t))
    return found.select("review_id", (~F.isnan("suspicious_probability")).alias("above"))


@query(
    "T4_missing_text_score",
    f"""with {REVIEWS} select review_id, coalesce(case when length(content) >= 400 and length(content) < 5000 then round_even((1 - (row_no*37 % 101)/100.0::double)*100, 0) end, -1) as text_score,
  length(content) < 400 as no_rules from reviews""",
)
def t4(t: Tables) -> DataFrame:
    """Short documents are blanked, for long ones the prediction is missing."""
    size = F.length("content")
    known = t.reviews().filter(size < 5000).select("review_id")
    probabilities = t.probabilities().join(known, "review_id", "left_semi")
    blanked = t.reviews().withColumn("content", F.when(size >= 400, F.col("content")).otherwise(" \n"))
    return text_signal.text_signal(blanked, probabilities).select(
        "review_id", meta.to_public(F.col("text_score")).alias("text_score"), F.col("text_rule_score").isNull().alias("no_rules")
    )


def _length_predictor():
    """A stand-in model: longer texts look more suspicious."""

    def predict(texts: pd.Series) -> pd.Series:
        return texts.str.len().clip(upper=10_000) / 10_000.0

    return predict


@query("T5_score_texts", "select cast(doc_id as varchar) as review_id, round(least(length(text), 10000)/10000.0::double, 6) as probability from documents")
def t5(t: Tables) -> DataFrame:
    rows = text_signal.score_texts(t.reviews(), _length_predictor, batch_size=64)
    return rows.select("review_id", r6("suspicious_probability").alias("probability"))


# --- 2.5 behavior signal ------------------------------------------------------------------------

ARRAY_COUNT_SQL = """(1 + ((ts + m1 * interval 1 minute)::date = ts::date)::bigint + ((ts - m2 * interval 1 minute)::date = ts::date)::bigint)"""


@query("B1_reviews_today", f"with {CREATED_SQL} select review_id, {ARRAY_COUNT_SQL} as today from inputs")
def b1(t: Tables) -> DataFrame:
    return behavior_signal.reviews_written_today(t.behavior_inputs()).select("review_id", F.col("reviews_written_today").alias("today"))


HISTORY_SQL = """daily as (select user_id, ts::date as d, count(*) as n from events group by 1, 2),
totals as (select user_id, count(*) as n from events group by 1),
counted as (select a.*, case when t.n >= 2 then coalesce(daily.n, 0) end as today from aged a left join totals t using (user_id) left join daily on daily.user_id = a.user_id and daily.d = a.ts::date)"""


@query("B2_reviews_today_from_history", f"with {CREATED_SQL}, {HISTORY_SQL} select review_id, today from counted")
def b2(t: Tables) -> DataFrame:
    rows = behavior_signal.reviews_written_today_from_history(t.behavior_inputs(), t.history())
    return rows.select("review_id", F.col("reviews_written_today").alias("today"))


BEHAVIOR_SQL = f"""{CREATED_SQL}, {HISTORY_SQL},
parts as (select *, case when verified then 100.0 when not verified then 70.0 end::double as ps, case when age < 0 then null when age < 7 then 80.0 when age >= 7 then 100.0 end::double as ags,
  case when today >= 3 then 85.0 when today is not null then 100.0 end::double as fs from counted),
behavior as (select *, (coalesce(ps*0.5,0) + coalesce(ags*0.2,0) + coalesce(fs*0.3,0)) / nullif((case when ps is null then 0 else 0.5 end + case when ags is null then 0 else 0.2 end + case when fs is null then 0 else 0.3 end)::double, 0) as bs from parts)"""


def _behavior(t: Tables) -> DataFrame:
    return behavior_signal.behavior_signal(t.behavior_inputs(), t.history())


@query("B3_subscores", f"with {BEHAVIOR_SQL} select review_id, ps as purchase_score, ags as account_age_score, fs as frequency_score from behavior")
def b3(t: Tables) -> DataFrame:
    return _behavior(t).select("review_id", "purchase_score", "account_age_score", "frequency_score")


@query("B4_behavior_score", f"with {BEHAVIOR_SQL} select review_id, round(bs, 6) as behavior_score from behavior")
def b4(t: Tables) -> DataFrame:
    return _behavior(t).select("review_id", r6("behavior_score").alias("behavior_score"))


@query(
    "B5_behavior_reasons",
    f"""with {BEHAVIOR_SQL} select review_id, concat_ws('|', case when not verified then 'PURCHASE_NOT_VERIFIED' end, case when age between 0 and 6 then 'NEW_ACCOUNT' end,
  case when today >= 3 then 'MULTIPLE_REVIEWS_SAME_DAY' end) as reasons, concat_ws('|', case when age < 0 then 'account_created_after_review' end, case when bs is null then 'insufficient_behavior_evidence' end) as missing from behavior""",
)
def b5(t: Tables) -> DataFrame:
    return _behavior(t).select(
        "review_id", joined(codes("behavior_reasons")).alias("reasons"), joined("behavior_unavailable_reasons").alias("missing")
    )


# --- 2.6 network signal -------------------------------------------------------------------------

NETWORK_TEXTS = f"""texts as (select doc_id as id, source as p, text from documents), {CHARS_SQL},
named as (select g.id, p, term, count(*) as tf from grams g join texts using (id) group by 1, 2, 3),
sizes as (select p, count(*) filter (length(c) >= 2) as n from canon join texts using (id) group by 1),
idf as (select p, term, count(*) as df, 1 + ln((1 + any_value(n))/(1 + count(*))::double) as idf from named join sizes using (p) group by 1, 2),
raw as (select id, p, term, tf, tf * idf as w from named join idf using (p, term)),
norms as (select id, sqrt(sum(w*w)) as norm from raw group by 1),
tfidf as (select id, p, term, tf, w / norm as w from raw join norms using (id))"""
PAIRS_SQL = f"""{NETWORK_TEXTS},
info as (select id, p, c, length(c) as len from canon join texts using (id) where length(c) >= 10),
shared as (select a.id as l, b.id as r, sum(a.w*b.w) as cosine, sum(case when length(a.term) = 2 then least(a.tf, b.tf) else 0 end) as overlap
  from tfidf a join tfidf b on a.p = b.p and a.term = b.term and a.id < b.id group by 1, 2),
pairs as (select a.id as l, b.id as r, case when a.c = b.c then 1.0 else least(1, coalesce(cosine, 0)) end::double as cosine,
  case when a.c = b.c then 1.0 else 2*coalesce(overlap, 0)/(a.len + b.len - 2) end::double as dice from info a join info b on a.p = b.p and a.id < b.id left join shared s on s.l = a.id and s.r = b.id),
hybrid as (select l, r, cosine, dice, case when cosine = 1 and dice = 1 then 1.0 else 0.4*cosine + 0.6*dice end::double as hybrid from pairs)"""


def evidence_sql(measure: str) -> str:
    return f"""{PAIRS_SQL},
sided as (select l as id, {measure} as s from hybrid union all select r, {measure} from hybrid),
evidence as (select id, count(*) filter (s >= 0.85) as k, max(s) as smax, avg(s) as smean, list_avg(list_sort(list(s), 'DESC')[1:3]) as top3, count(*) as compared from sided group by 1),
features as (select d.doc_id as id, d.source as p, k, smax, smean, top3, coalesce(compared, 0) as compared from documents d left join evidence e on e.id = d.doc_id)"""


SCORE_SQL = """least(100, greatest(0, 100 - 55*pow(least(1, greatest(0, (smax - 0.5)/0.5)), 2) - 30*pow(least(1, greatest(0, (top3 - 0.5)/0.5)), 2) - 15*(1 - exp(-k/2))))"""
FEATURES_SQL = "select cast(id as varchar) as review_id, k as similar, round(smax, 6) as largest, round(smean, 6) as mean, round(top3, 6) as top3, compared from features"


def _features(rows: DataFrame) -> DataFrame:
    return rows.select(
        "review_id",
        F.col("similar_review_count").alias("similar"),
        r6("similarity_max").alias("largest"),
        r6("similarity_mean").alias("mean"),
        r6("top3_mean_similarity").alias("top3"),
        F.col("compared_review_count").alias("compared"),
    )


@query("N1_gram_counts", f"with {NETWORK_TEXTS} select p as product_id, length(term)::int as size, count(*) as entries, sum(tf)::bigint as grams, max(tf)::bigint as most from named group by 1, 2")
def n1(t: Tables) -> DataFrame:
    grams = network_signal.gram_counts(network_signal.distinct_texts(t.reviews()), ("product_id", "copies"))
    return grams.groupBy("product_id", F.length("term").alias("size")).agg(
        F.sum("copies").alias("entries"), F.sum(F.col("tf") * F.col("copies")).alias("grams"), big(F.max("tf")).alias("most")
    )


@query("N2_gram_idf", f"with {NETWORK_TEXTS} select p as product_id, length(term)::int as size, count(*) as terms, max(df)::bigint as most, round(sum(idf), 3) as idf from idf group by 1, 2")
def n2(t: Tables) -> DataFrame:
    texts = network_signal.distinct_texts(t.reviews())
    idf = network_signal.gram_idf(network_signal.gram_copies(texts), network_signal.product_stats(texts))
    return idf.groupBy("product_id", F.length("term").alias("size")).agg(
        F.count("*").alias("terms"), F.max("df").alias("most"), F.round(F.sum("idf"), 3).alias("idf")
    )


@query("N3_tfidf", f"with {NETWORK_TEXTS} select p as product_id, cast(id as varchar) as review_id, count(*) as terms, round(sum(w), 6) as total, round(max(w), 6) as largest from tfidf group by 1, 2")
def n3(t: Tables) -> DataFrame:
    keyed = materialized(network_signal.with_canonical(t.reviews()).drop("content"), "canonical")
    per_text = (
        network_signal.tfidf(keyed)
        .groupBy("product_id", "text_key")
        .agg(F.count("*").alias("terms"), r6(F.sum("weight")).alias("total"), r6(F.max("weight")).alias("largest"))
    )
    return keyed.select("product_id", "review_id", "text_key").join(per_text, ["product_id", "text_key"]).drop("text_key")


def _measured(measure: str) -> Callable[[Tables], DataFrame]:
    return lambda t: _features(network_signal.network_signal(t.reviews(), measure))


query("N4_cosine_evidence", f"with {evidence_sql('cosine')} {FEATURES_SQL}")(_measured("cosine"))
query("N5_dice_evidence", f"with {evidence_sql('dice')} {FEATURES_SQL}")(_measured("dice"))
query("N6_hybrid_evidence", f"with {evidence_sql('hybrid')} {FEATURES_SQL}")(_measured("hybrid"))

EXACT_SQL = f"""info as (select doc_id as id, source as p, {sql_norm('text')} as norm from documents where length({sql_canon('text')}) >= 10),
sized as (select p, norm, count(*) as same from info group by 1, 2), totals as (select p, count(*) as n from info group by 1),
evidence as (select id, i.p, same - 1 as k, n - 1 as compared from info i join sized using (p, norm) join totals on totals.p = i.p where n > 1),
features as (select d.doc_id as id, k, case when k > 0 then 1.0 when k = 0 then 0.0 end::double as smax, k/compared::double as smean,
  case when k is not null then least(3, k)/least(3, compared)::double end as top3, coalesce(compared, 0) as compared from documents d left join evidence e on e.id = d.doc_id)"""


@query("N7_exact_match_evidence", f"with {EXACT_SQL} {FEATURES_SQL}")
def n7(t: Tables) -> DataFrame:
    return _features(network_signal.exact_match_signal(t.reviews()))


def _length_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """A user similarity: ratio of lengths, undefined below one half."""
    a, b = left.str.len(), right.str.len()
    ratio = a.where(a < b, b) / a.where(a > b, b)
    return ratio.where(ratio >= 0.5)


USER_SQL = f"""info as (select doc_id as id, source as p, length(text) as len from documents where length({sql_canon('text')}) >= 10),
sided as (select a.id, least(a.len, b.len)/greatest(a.len, b.len)::double as s from info a join info b on a.p = b.p and a.id <> b.id),
evidence as (select id, count(*) filter (s >= 0.85) as k, max(s) as smax, avg(s) as smean, list_avg(list_sort(list(s), 'DESC')[1:3]) as top3, count(*) as compared from sided where s >= 0.5 group by 1),
features as (select d.doc_id as id, k, smax, smean, top3, coalesce(compared, 0) as compared from documents d left join evidence e on e.id = d.doc_id)"""


@query("N8_user_similarity", f"with {USER_SQL} {FEATURES_SQL}")
def n8(t: Tables) -> DataFrame:
    return _features(network_signal.user_similarity_signal(t.reviews(), _length_similarity))


@query("N9_similarity_sums", f"with {evidence_sql('hybrid')} select cast(id as varchar) as review_id, p as product_id, round(smean, 6) as mean, compared from features")
def n9_sums(t: Tables) -> DataFrame:
    sums = similarity_sums.similarity_sums(t.reviews())
    return sums.select("review_id", "product_id", r6("similarity_mean").alias("mean"), F.col("compared_review_count").alias("compared"))


@query("N9_network_features", f"with {evidence_sql('hybrid')} select p as product_id, count(smax) as scored, sum(k)::bigint as similar, round(max(smax), 6) as largest, round(avg(smean), 6) as mean, round(avg(top3), 6) as top3, sum(compared)::bigint as compared from features group by 1")
def n9(t: Tables) -> DataFrame:
    return network_signal.network_signal(t.reviews()).groupBy("product_id").agg(
        F.count("similarity_max").alias("scored"), F.sum("similar_review_count").alias("similar"),
        r6(F.max("similarity_max")).alias("largest"), r6(F.avg("similarity_mean")).alias("mean"),
        r6(F.avg("top3_mean_similarity")).alias("top3"), F.sum("compared_review_count").alias("compared"),
    )


@query("N10_network_score", f"with {evidence_sql('hybrid')} select cast(id as varchar) as review_id, case when smax is not null then {sql_round1(SCORE_SQL)} end as network_score from features")
def n10(t: Tables) -> DataFrame:
    return network_signal.network_signal(t.reviews()).select("review_id", "network_score")


@query("N11_network_reasons", f"with {evidence_sql('hybrid')} select cast(id as varchar) as review_id, case when k >= 5 then 'SIMILAR_REVIEW_CLUSTER' when k >= 1 then 'SIMILAR_REVIEW_PATTERN' else '' end as reasons from features")
def n11(t: Tables) -> DataFrame:
    return network_signal.network_signal(t.reviews()).select("review_id", joined(codes("network_reasons")).alias("reasons"))


SHORTENED = "case when n_chars < 300 then 'ok !!!' when n_chars < 600 then ' ' else text end"


@query(
    "N12_network_unavailable",
    f"""with blanked as (select doc_id, source, {SHORTENED} as text from documents),
facts as (select *, trim(text) = '' as blank, length({sql_canon('text')}) >= 10 as informative from blanked),
totals as (select source, count(*) filter (not blank) as n, count(*) filter (informative) as ninf from facts group by 1)
select cast(doc_id as varchar) as review_id, case when informative and ninf > 1 then null when blank or n - 1 < 1 then 'no_comparison_reviews'
  when not informative then 'insufficient_text_information' else 'similarity_unavailable' end as reason,
  case when informative and ninf > 1 then null else 'similarity_unavailable' end as batch_reason from facts join totals using (source)""",
)
def n12(t: Tables) -> DataFrame:
    size = F.length("content")
    rows = t.reviews().withColumn("content", F.when(size < 300, "ok !!!").when(size < 600, " ").otherwise(F.col("content")))
    adapter = network_signal.exact_match_signal(rows).select("review_id", F.col("network_unavailable_reason").alias("reason"))
    batch = network_signal.network_signal(rows).select("review_id", F.col("network_unavailable_reason").alias("batch_reason"))
    return adapter.join(batch, "review_id")


@query(
    "N13_network_for_target",
    f"""with {evidence_sql('hybrid')} select p as product_id, cast(id as varchar) as review_id, k as similar, round(smax, 6) as largest, round(smean, 6) as mean,
  round(top3, 6) as top3, compared, case when smax is not null then {sql_round1(SCORE_SQL)} end as network_score from features where id in (select min(doc_id) from documents group by source)""",
)
def n13(t: Tables) -> DataFrame:
    """The first review of every product against all its peers."""
    targets = t.reviews().groupBy("product_id").agg(F.min_by("review_id", "row_no").alias("review_id"))
    rows = network_signal.target_signal(t.reviews(), targets)
    return rows.select(
        "product_id", "review_id", F.col("similar_review_count").alias("similar"), r6("similarity_max").alias("largest"),
        r6("similarity_mean").alias("mean"), r6("top3_mean_similarity").alias("top3"),
        F.col("compared_review_count").alias("compared"), "network_score",
    )


# --- 2.7 trust index ----------------------------------------------------------------------------


def _three_scores(t: Tables) -> DataFrame:
    """Three scores per event, each missing for part of the values."""
    value = F.col("value")
    return t.events().select(
        F.col("event_id").cast("string").alias("review_id"),
        F.when(value < 150, numbers.clip(value, 0, 100)).alias("text_score"),
        F.when((value > 20) & (value < 200), numbers.clip(value / 2, 0, 100)).alias("behavior_score"),
        F.when(value > 60, numbers.clip(value / 3, 0, 100)).alias("network_score"),
    )


def sql_three(weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> str:
    a, b, c = weights
    return f"""three as (select cast(event_id as varchar) as review_id, case when value < 150 then least(100, value) end::double as t,
  case when value > 20 and value < 200 then least(100, value/2) end::double as b, case when value > 60 then least(100, value/3) end::double as n from events),
weighed as (select *, (case when t is null then 0 else {a} end + case when b is null then 0 else {b} end + case when n is null then 0 else {c} end)::double as ws from three),
meta as (select *, coalesce(t*({a}/ws),0) + coalesce(b*({b}/ws),0) + coalesce(n*({c}/ws),0) as rti from weighed)"""


@query("M1_meta_score", f"with {sql_three()} select review_id, round(rti, 6) as rti from meta")
def m1(t: Tables) -> DataFrame:
    return meta.meta_score(_three_scores(t)).select("review_id", r6("rti").alias("rti"))


@query(
    "M2_signals_and_weights",
    f"""with {sql_three()} select review_id, concat_ws('|', case when t is not null then 'text' end, case when b is not null then 'behavior' end, case when n is not null then 'network' end) as used,
  concat_ws('|', case when t is null then 'text' end, case when b is null then 'behavior' end, case when n is null then 'network' end) as unavailable,
  round(case when t is not null then 0.5/ws end, 6) as text_weight, round(case when b is not null then 0.3/ws end, 6) as behavior_weight, round(case when n is not null then 0.2/ws end, 6) as network_weight, round(ws, 6) as base from meta""",
)
def m2(t: Tables) -> DataFrame:
    rows = meta.meta_score(_three_scores(t))
    return rows.select(
        "review_id", joined("used_signals").alias("used"), joined("unavailable_signals").alias("unavailable"),
        *[r6(F.col("applied_weights")[name]).alias(f"{name}_weight") for name in C.SIGNALS], r6("base_weight_sum").alias("base"),
    )


@query("M3_level", f"select event_id, {sql_level('least(100, value)')} as level from events")
def m3(t: Tables) -> DataFrame:
    return t.events().select("event_id", meta.classify_rti(numbers.clip(F.col("value"), 0, 100)).alias("level"))


@query("M4_rti_from_public", f"with {sql_three()} select review_id, {sql_round1('rti')} as rti, coalesce(t, -1) as text_score from meta")
def m4(t: Tables) -> DataFrame:
    public = _three_scores(t).select("review_id", *[meta.to_public(F.col(f"{n}_score")).alias(f"{n}_score") for n in C.SIGNALS])
    return meta.rti_from_public(public).select("review_id", "rti", "text_score")


@query("M5_custom_weights", f"with {sql_three((0.2, 0.2, 1.5))} select review_id, round(rti, 6) as rti from meta")
def m5(t: Tables) -> DataFrame:
    return meta.meta_score(_three_scores(t), meta.Weights(0.2, 0.2, 1.5)).select("review_id", r6("rti").alias("rti"))


def _pipeline_input(t: Tables) -> DataFrame:
    """Reviews with probabilities and the behavior facts of the event that has the document's number."""
    facts = t.behavior_inputs().select(
        F.col("row_no"), "user_id", "review_date", "verified_purchase", "account_created_at", "user_review_dates"
    )
    return t.reviews().join(facts, "row_no", "left").join(t.probabilities().select("row_no", "suspicious_probability"), "row_no")


def _pipeline_sql() -> str:
    words = [f"({sql_count('text', w)} >= 2)" for w in C.REPETITIVE_KEYWORDS]
    short, loud = f"length({sql_strip('text')}) < 20", f"{sql_count('text', '!')} >= 3"
    return f"""{evidence_sql('hybrid')}, {CREATED_SQL},
same_day as (select *, {ARRAY_COUNT_SQL} as today from aged),
parts as (select *, case when verified then 100.0 when not verified then 70.0 end::double as ps, case when age < 0 then null when age < 7 then 80.0 when age >= 7 then 100.0 end::double as ags,
  case when today >= 3 then 85.0 when today is not null then 100.0 end::double as fs from same_day),
behavior as (select *, (coalesce(ps*0.5,0) + coalesce(ags*0.2,0) + coalesce(fs*0.3,0)) / nullif((case when ps is null then 0 else 0.5 end + case when ags is null then 0 else 0.2 end + case when fs is null then 0 else 0.3 end)::double, 0) as bs from parts),
signals as (select f.id, f.p, d.text, round_even((1 - (f.id*37 % 101)/100.0::double)*100, 0) as t, bs as b, case when smax is not null then {sql_round1(SCORE_SQL)} end as n, k,
  verified, age, behavior.today from features f join documents d on d.doc_id = f.id left join behavior on behavior.review_id = cast(f.id as varchar)),
weighed as (select *, (0.5 + case when b is null then 0 else 0.3 end + case when n is null then 0 else 0.2 end)::double as ws from signals),
meta as (select *, t*(0.5/ws) + coalesce(b*(0.3/ws),0) + coalesce(n*(0.2/ws),0) as rti from weighed),
flat as (select cast(id as varchar) as review_id, p as product_id, rti, {sql_round1('rti')} as rounded, t as text_score, coalesce(b, -1) as behavior_score, coalesce(n, -1) as network_score,
  concat_ws('|', case when {' or '.join(words)} then 'TEXT_REPETITIVE_KEYWORD' end, case when {short} then 'TEXT_SHORT_REVIEW' end, case when {loud} then 'TEXT_EXCESSIVE_EXCLAMATION' end,
   case when not verified then 'BEHAVIOR_PURCHASE_NOT_VERIFIED' end, case when age between 0 and 6 then 'BEHAVIOR_NEW_ACCOUNT' end, case when today >= 3 then 'BEHAVIOR_MULTIPLE_REVIEWS_SAME_DAY' end,
   case when k >= 5 then 'NETWORK_SIMILAR_REVIEW_CLUSTER' when k >= 1 then 'NETWORK_SIMILAR_REVIEW_PATTERN' end) as reasons from meta)"""


@query("M6_analyze_reviews", f"with {_pipeline_sql()} select product_id, review_id, round(rti, 5) as rti, {sql_level('rti')} as level, text_score, round(behavior_score, 6) as behavior_score, network_score from flat")
def m6(t: Tables) -> DataFrame:
    rows = analyze_reviews(_pipeline_input(t))
    return rows.select(
        "product_id", "review_id", F.round("rti", 5).alias("rti"), "level", "text_score",
        r6(meta.to_public(F.col("behavior_score"))).alias("behavior_score"), meta.to_public(F.col("network_score")).alias("network_score"),
    )


@query("M7_flat_results", f"with {_pipeline_sql()} select product_id, review_id, rounded as rti, {sql_level('rounded')} as level, text_score, round(behavior_score, 6) as behavior_score, network_score, reasons from flat")
def m7(t: Tables) -> DataFrame:
    return analyze_flat(_pipeline_input(t)).select(
        "product_id", "review_id", "rti", "level", "text_score", r6("behavior_score").alias("behavior_score"), "network_score",
        joined("reasons").alias("reasons"),
    )


def _faulty_batch(t: Tables) -> DataFrame:
    """Blank ids, ids used twice within a product, and invalid probabilities."""
    number = F.col("row_no")
    shared = number % 10 < 2
    return (
        _faulty_probabilities(t)
        .select("row_no", "suspicious_probability")
        .join(t.reviews(), "row_no")
        .withColumn("product_id", F.when(shared, "shared").when(number % 19 == 4, " ").otherwise(F.col("product_id")))
        .withColumn(
            "review_id",
            F.when(number % 13 == 0, F.lit("  "))
            .when(shared, F.floor(number / 10).cast("string"))
            .otherwise(F.concat(F.lit("d"), number.cast("string"))),
        )
    )


FAULTY_SQL = """batch as (select doc_id as n, case when doc_id % 10 < 2 then 'shared' when doc_id % 19 = 4 then ' ' else source end as product_id,
  case when doc_id % 13 = 0 then '  ' when doc_id % 10 < 2 then cast(doc_id // 10 as varchar) else 'd' || doc_id end as review_id,
  doc_id % 7 = 3 or doc_id % 11 = 5 as faulty from documents),
ids as (select product_id, review_id, count(*) as rows from batch group by 1, 2),
rejected as (select product_id, review_id, 'blank_product_id' as violation, rows from ids where trim(product_id) = ''
  union all select product_id, review_id, 'blank_review_id', rows from ids where trim(review_id) = ''
  union all select product_id, review_id, 'duplicate_review_id', rows from ids where rows > 1 and trim(review_id) <> ''
  union all select product_id, review_id, 'invalid_probability', count(*) from batch where faulty group by 1, 2)"""


@query("M6_rejected", f"with {FAULTY_SQL} select * from rejected")
def m6b(t: Tables) -> DataFrame:
    return rejected_reviews(_faulty_batch(t))


@query(
    "M6_scored_of_faulty_batch",
    f"""with {FAULTY_SQL} select b.product_id, b.review_id, true as in_range from batch b
where not exists (select 1 from rejected r where r.product_id = b.product_id and r.review_id = b.review_id)""",
)
def m6c(t: Tables) -> DataFrame:
    """Only valid reviews are scored, and every index lies within 0..100 or is the sentinel."""
    flat = analyze_flat(_faulty_batch(t))
    inside = F.col("rti").between(0, 100) | (F.col("rti") == C.MISSING)
    return flat.select("product_id", "review_id", inside.alias("in_range"))


# --- 2.8 labelled data --------------------------------------------------------------------------


@query("D1_dedup_first", f"with {SELECTED} select row_no, own_label as label, md5(text) as text from grouped")
def d1(t: Tables) -> DataFrame:
    return labelled.dedup_first(selected_rows(t)).select("row_no", "label", F.md5("text").alias("text"))


@query("D2_drop_conflicts", f"with {SELECTED} select row_no, label, md5(text) as text from examples")
def d2(t: Tables) -> DataFrame:
    return labelled.prepare_examples(selected_rows(t)).select("row_no", "label", F.md5("text").alias("text"))


@query(
    "D3_prep_audit",
    f"""with {SELECTED} select sum(n)::bigint as raw_selected, (sum(n) - count(*) filter (label = top_label))::bigint as duplicate_rows_removed,
  count(*) filter (label <> top_label) as conflicting_groups_removed, count(*) filter (label = top_label) as kept from grouped""",
)
def d3(t: Tables) -> DataFrame:
    return labelled.prep_audit(selected_rows(t))


@query("D4_stratified_split", f"with {SPLITS} select row_no, label, split from splits")
def d4(t: Tables) -> DataFrame:
    return scored_splits(t).select("row_no", "label", "split")


@query("D5_class_weights", f"with {SPLITS} select label, round((select count(*) from splits where split = 'train')/(2*count(*)), 6) as weight from splits where split = 'train' group by 1")
def d5(t: Tables) -> DataFrame:
    train = scored_splits(t).filter(F.col("split") == "train")
    return labelled.class_weights(train).select("label", r6("weight").alias("weight"))


@query("D6_split_counts", f"""with {SPLITS} select split, count(*) filter (label = 0) as "NORMAL", count(*) filter (label = 1) as "SUSPICIOUS" from splits group by 1""")
def d6(t: Tables) -> DataFrame:
    return labelled.split_counts(scored_splits(t))


@query("D7_assemble", f"with {ASSEMBLED_SQL} select source_set, source_id, md5(content) as content, final_label, source_note from assembled")
def d7(t: Tables) -> DataFrame:
    return assembly.assemble(_sources(t)).select("source_set", "source_id", F.md5("content").alias("content"), "final_label", "source_note")


@query(
    "D8_assemble_audit",
    f"""with {SOURCES_SQL} select coalesce(source_set, 'TOTAL') as source_set, count(*) as rows_read, count(*) filter (ok and trim(content) <> '' and label = 'NORMAL') as "NORMAL",
  count(*) filter (ok and trim(content) <> '' and label = 'SUSPICIOUS') as "SUSPICIOUS", count(*) filter (ok and trim(content) = '') as empty_content_excluded,
  count(*) filter (ok and trim(content) <> '') as output_rows from raw group by rollup (source_set)""",
)
def d8(t: Tables) -> DataFrame:
    return assembly.assemble_audit(_sources(t))


SYNTH_SQL = f"""{SPLITS},
synth as (select item_id as row_no, {sql_strip('text')} as text from benchmark union all select row_no + 1000000000000, {sql_strip('upper(review)')} from master where trim(final_label) = 'suspicious'),
synth_groups as (select {sql_norm('text')} as norm, min_by(text, row_no) as text from synth where text <> '' group by 1),
added as (select * from synth_groups where norm not in (select norm from splits))"""


@query("D9_augment_train", f"with {SYNTH_SQL} select md5(text) as text, label, split, false as synthetic from splits union all select md5(text), 1, 'train', true from added")
def d9(t: Tables) -> DataFrame:
    rows = assembly.augment_train(scored_splits(t), t.synthetic())
    return rows.select(F.md5("text").alias("text"), "label", "split", "synthetic")


@query(
    "D10_augmentation_problems",
    """select problem from (select count(*) filter (toxic = 0 and quality = 1) as n from documents join labels using (doc_id)), (values ('contains_normal'), ('not_suspicious')) p(problem) where n > 0""",
)
def d10(t: Tables) -> DataFrame:
    """The labelled documents are no valid augmentation: they hold normal rows."""
    rows = t.master().select("row_no", F.col("review").alias("content"), "final_label", F.lit("YES").alias("use_for_training"))
    return assembly.augmentation_problems(rows)


@query(
    "D11_augment_audit",
    f"""with {SYNTH_SQL} select (select count(*) from synth where text <> '') as augmentation_raw_selected, (select count(*) from synth_groups) as augmentation_used_after_deduplication,
  (select count(*) from synth_groups) - (select count(*) from added) as augmentation_real_collision_removed, (select count(*) from added) as augmentation_added_to_train,
  (select count(*) from splits where split = 'train') as train_before, (select count(*) from splits where split = 'train') + (select count(*) from added) as train_after""",
)
def d11(t: Tables) -> DataFrame:
    return assembly.augment_audit(scored_splits(t), t.synthetic())


@query("D12_master_rows", f"with {SELECTED} select cast(row_no as varchar) as master_id, label, md5(text) as text from examples")
def d12(t: Tables) -> DataFrame:
    prepared = labelled.prepare_examples(selected_rows(t))
    rows = diagnosis_join.prepare_master_rows(t.master(), prepared)
    return rows.select("master_id", "label", F.md5("text").alias("text"))


ATTACHED_SQL = f"""{SCORED}, {DIAGNOSES},
attached as (select cast(s.row_no as varchar) as master_id, split, text as review, d.diagnostic_type, probability from scored s join diagnoses d on d.row_no = s.row_no where label = 1)"""


def _attached(t: Tables, check: bool = True) -> tuple[DataFrame, DataFrame]:
    master = materialized(diagnosis_join.prepare_master_rows(t.master(), check=check), "master")
    diagnoses = materialized(readers.load_diagnoses(t.diagnoses(), check=check), "diagnoses")
    return diagnoses, diagnosis_join.attach_by_id(scored_splits(t), master, diagnoses, check)


@query("D13_attach_by_id", f"with {ATTACHED_SQL} select master_id, split, diagnostic_type, md5(review) as review from attached")
def d13(t: Tables) -> DataFrame:
    return _attached(t)[1].select("master_id", "split", "diagnostic_type", F.md5("review").alias("review"))


@query(
    "D14_attach_by_text",
    f"""with {SPLITS}, {DIAGNOSES}, by_text as (select {sql_norm('review')} as norm, min_by(master_id, row_no) as master_id, min_by(diagnostic_type, row_no) as diagnostic_type from diagnoses group by 1)
select master_id, diagnostic_type, md5(text) as review from splits join by_text using (norm) where label = 1""",
)
def d14(t: Tables) -> DataFrame:
    rows = diagnosis_join.attach_by_text(scored_splits(t), readers.load_diagnoses_by_text(t.diagnoses()))
    return rows.select("master_id", "diagnostic_type", F.md5("review").alias("review"))


# --- 2.9 evaluation -----------------------------------------------------------------------------


@query("E1_classification_metrics", E1_SQL)
def e1(t: Tables) -> DataFrame:
    rows = scored_splits(t).select("label", (F.col("probability") >= 0.5).cast("int").alias("predicted"))
    return rounded_metrics(evaluation.classification_metrics(rows))


SWEEP_SQL = f"""{SCORED}, grid as (select k/100.0::double as threshold from range(5, 100, 5) g(k)),
cells as (select threshold, {CELLS_SQL} from (select threshold, label, (probability >= threshold)::int as predicted from scored, grid) group by 1), {sql_metrics('cells', 'threshold,')}"""


@query("E2_threshold_sweep", f"with {SWEEP_SQL} select threshold, {ROUNDED_SQL} from metrics")
def e2(t: Tables) -> DataFrame:
    return rounded_metrics(evaluation.threshold_sweep(scored_splits(t)), "threshold")


@query("E3_select_threshold", f"with {SWEEP_SQL} select threshold, {ROUNDED_SQL} from metrics order by metrics.suspicious_f1 desc, metrics.suspicious_recall desc, abs(threshold - 0.5), threshold limit 1")
def e3(t: Tables) -> DataFrame:
    return rounded_metrics(evaluation.select_threshold(evaluation.threshold_sweep(scored_splits(t))), "threshold")


def _attached_scored(t: Tables) -> DataFrame:
    return _attached(t)[1].withColumn("probability", (F.col("master_id").cast("bigint") * 37) % 101 / 100.0)


@query(
    "E4_recall_by_type",
    f"""with {ATTACHED_SQL}, grid as (select split, type as diagnostic_type from (select distinct split from attached), (values ('TEXT_STRONG'), ('TEXT_WEAK'), ('NETWORK_STRONG'), ('TOTAL')) v(type))
select g.split, g.diagnostic_type, count(a.review) as total, count(*) filter (probability >= 0.3) as detected, count(a.review) - count(*) filter (probability >= 0.3) as missed,
  round(count(*) filter (probability >= 0.3)/nullif(count(a.review), 0), 6) as recall from grid g left join attached a on a.split = g.split and (g.diagnostic_type = 'TOTAL' or a.diagnostic_type = g.diagnostic_type) group by 1, 2""",
)
def e4(t: Tables) -> DataFrame:
    return evaluation.recall_by_type(_attached_scored(t)).withColumn("recall", r6("recall"))


@query(
    "E5_type_distribution",
    f"""with {ATTACHED_SQL}, names as (select * from (values ('TEXT_STRONG'), ('TEXT_WEAK'), ('NETWORK_STRONG'), ('TOTAL')) v(diagnostic_type))
select n.diagnostic_type, (select count(*) from diagnoses d where n.diagnostic_type in ('TOTAL', d.diagnostic_type)) as reviewed_total, count(a.review) as usable_total,
  count(*) filter (split = 'train') as train, count(*) filter (split = 'validation') as validation, count(*) filter (split = 'test') as test
from names n left join attached a on n.diagnostic_type in ('TOTAL', a.diagnostic_type) group by 1""",
)
def e5(t: Tables) -> DataFrame:
    diagnoses, attached = _attached(t)
    return evaluation.type_distribution(diagnoses, attached)


@query(
    "E6_suspicious_examples",
    f"""with {SCORED} select row_no, split, probability, case when probability >= 0.4 then 'SUSPICIOUS' else 'NORMAL' end as predicted_label,
  case when length({sql_space('text')}) > 180 then substr({sql_space('text')}, 1, 179) || '…' else {sql_space('text')} end as text from scored where label = 1""",
)
def e6(t: Tables) -> DataFrame:
    return evaluation.suspicious_examples(scored_splits(t), 0.4)


@query(
    "E7_text_strong_details",
    f"""with {ATTACHED_SQL} select master_id, split, md5(review) as review, case when split <> 'train' then probability end as probability,
  case when split <> 'train' then case when probability >= 0.3 then 'SUSPICIOUS' else 'NORMAL' end end as prediction, case when split <> 'train' then probability >= 0.3 end as detected
from attached where diagnostic_type = 'TEXT_STRONG'""",
)
def e7(t: Tables) -> DataFrame:
    return evaluation.text_strong_details(_attached_scored(t)).withColumn("review", F.md5("review"))


# --- 2.10 diagnosis -----------------------------------------------------------------------------


def _thrice_sql(content: str, name: str) -> str:
    return f"""{name} as (select distinct id from (select id, s from (select id, {sql_space('s')} as s from (select id, unnest(regexp_split_to_array({content}, '[.!?。！？]+|\\n+')) as s from src))
  where length(s) >= 2 group by id, s having count(*) >= 3))"""


REPEAT_SQL = f"""toks as (select id, regexp_extract_all({sql_norm('text')}, '[가-힣A-Za-z0-9]+') as ts from src),
tok as (select id, unnest(ts) as t, unnest(range(1, len(ts) + 1)) as i, len(ts) as n from toks where len(ts) > 0),
hits as (select a.id, b.i - a.i as size, a.i, a.t, a.n from tok a join tok b on a.id = b.id and a.t = b.t and b.i > a.i and b.i - a.i <= a.n // 2),
islands as (select *, i - row_number() over (partition by id, size order by i) as island from hits),
runs as (select id, size, island, count(*) as len, min_by(t, i) as first_token, any_value(n) as n from islands group by 1, 2, 3),
triple as (select distinct id from runs where len >= 2*size and (size >= 2 or length(first_token) >= 2)),
covering as (select distinct id from runs where size >= 4 and len >= size and (len // size + 1) * size >= 0.8 * n),
{_thrice_sql(sql_space('text'), 'plain_thrice')}, {_thrice_sql(sql_fold('text'), 'folded_thrice')},
flags as (select id, id in (from triple) or id in (from covering) or id in (from plain_thrice) as abnormal, id in (from triple) or id in (from folded_thrice) as clear from src)"""


@query("G1_abnormal_repetition", f"with {TEXTS}, src as (from texts), {REPEAT_SQL} select id, abnormal as abnormal_repetition from flags")
def g1(t: Tables) -> DataFrame:
    return diagnosis.abnormal_repetition(t.texts(), "text").select("id", "abnormal_repetition")


@query("G2_clear_repetition", f"with {TEXTS}, src as (from texts), {REPEAT_SQL} select id, clear as clear_repetition from flags")
def g2(t: Tables) -> DataFrame:
    return diagnosis.clear_repetition(t.texts(), "text").select("id", "clear_repetition")


def sql_any(x: str, patterns: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"regexp_matches({x}, '(?i){p}')" for p in patterns) + ")"


def sql_hits(x: str, patterns: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"regexp_matches({x}, '(?i){p}')::int" for p in patterns) + ")"


TYPED_SQL = f"""{MASTER}, src as (select row_no as id, review as text from master where upper(trim(final_label)) = 'SUSPICIOUS'), {REPEAT_SQL},
evidence as (select row_no, master_id, {sql_space('review')} as review, concat_ws(' ', note, collection_reason) as ev from master where upper(trim(final_label)) = 'SUSPICIOUS'),
typed as (select row_no, master_id, review, case when {sql_any('ev', C.NETWORK_EVIDENCE)} then 'NETWORK_STRONG' when abnormal then 'TEXT_STRONG'
  when {sql_any('ev', C.PRODUCT_COPY_EVIDENCE)} and ({sql_any('ev', C.LACK_OF_EXPERIENCE_EVIDENCE)} or not {sql_any("(review || ' ' || ev)", C.EXPERIENCE_EVIDENCE)}) then 'TEXT_STRONG'
  when {sql_any('ev', C.PROMOTION_EVIDENCE)} and {sql_any('ev', C.LACK_OF_EXPERIENCE_EVIDENCE)} then 'TEXT_STRONG' else 'TEXT_WEAK' end as diagnostic_type
  from evidence join flags on flags.id = evidence.row_no)"""


def _typed(t: Tables) -> DataFrame:
    return diagnosis.classify_reason(readers.load_suspicious(t.master()))


@query("G3_classify_reason", f"with {TYPED_SQL} select master_id, diagnostic_type from typed")
def g3(t: Tables) -> DataFrame:
    return _typed(t).select("master_id", "diagnostic_type")


LINE = r"(?:[-*•▪]|[0-9]+[.)]|✅|✔|☑|📌|💡|▶)"


@query(
    "G4_structured_info",
    f"""with {TEXTS} select id, len(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), lambda x: {sql_space('x')}), lambda x: regexp_matches(x, '^{LINE}'))) >= 2
  or len(regexp_extract_all(text, '(?i){C.SECTION_LABEL}')) >= 3 as structured_info from texts""",
)
def g4(t: Tables) -> DataFrame:
    """The tables hold no Korean headings, so the SQL states the other two rules; tests cover the headings."""
    return diagnosis.structured_info(t.texts(), "text").select("id", "structured_info")


@query("G5_personal_experience", over_texts(f"{sql_any('text', C.PERSONAL_EXPERIENCE)} as value"))
def g5(t: Tables) -> DataFrame:
    return t.texts().select("id", diagnosis.personal_experience(F.col("text")).alias("value"))


@query("G6_product_copy_count", over_texts(f"{sql_hits('text', C.PRODUCT_COPY_SIGNALS)} as value"))
def g6(t: Tables) -> DataFrame:
    return t.texts().select("id", diagnosis.product_copy_count(F.col("text")).alias("value"))


@query("G7_promotional_cta", over_texts(f"{sql_any('text', C.PROMOTIONAL_CTA)} as value"))
def g7(t: Tables) -> DataFrame:
    return t.texts().select("id", diagnosis.promo_cta(F.col("text")).alias("value"))


def sql_structured(x: str) -> str:
    return f"""(len(list_filter(list_transform(regexp_split_to_array({x}, '\\r\\n|[\\n\\r]'), lambda y: {sql_space('y')}), lambda y: regexp_matches(y, '^{LINE}'))) >= 2
  or len(regexp_extract_all({x}, '(?i){C.SECTION_LABEL}')) >= 3)"""


def sql_pattern(x: str, ev: str) -> str:
    personal, copies = sql_any(x, C.PERSONAL_EXPERIENCE), sql_hits(x, C.PRODUCT_COPY_SIGNALS)
    return f"""case when clear then 'REPETITION' when {sql_structured(x)} then 'STRUCTURED_INFO'
  when not {personal} and ({copies} >= 2 or ({copies} >= 1 and {sql_any(ev, C.COPY_SUPPORTING_EVIDENCE)})) then 'PRODUCT_COPY'
  when not {personal} and {sql_any(x, C.PROMOTIONAL_CTA)} then 'PROMOTIONAL_CTA' else 'AMBIGUOUS_TEXT_STRONG' end"""


@query(
    "G8_classify_pattern",
    f"""with {MASTER}, src as (select row_no as id, review as text from master), {REPEAT_SQL}
select master_id, {sql_pattern('review', "concat_ws(' ', collection_reason, note)")} as p_text_pattern from master join flags on flags.id = master.row_no""",
)
def g8(t: Tables) -> DataFrame:
    return diagnosis.classify_pattern(t.master()).select("master_id", "p_text_pattern")


STRONG_SQL = f"""{ATTACHED_SQL}, src as (select row_no as id, text from scored where label = 1), {REPEAT_SQL},
strong as (select a.master_id, a.review, {sql_pattern('a.review', "concat_ws(' ', collection_reason, note)")} as pattern from attached a join flags on cast(flags.id as varchar) = a.master_id
  join diagnoses d on cast(d.row_no as varchar) = a.master_id where a.diagnostic_type = 'TEXT_STRONG')"""


def _strong(t: Tables) -> DataFrame:
    master = materialized(diagnosis_join.prepare_master_rows(t.master()), "master")
    return diagnosis.usable_text_strong(master, materialized(readers.load_diagnoses(t.diagnoses()), "diagnoses"))


@query("G9_usable_text_strong", f"with {STRONG_SQL} select master_id, md5(review) as review, pattern as p_text_pattern, pattern <> 'AMBIGUOUS_TEXT_STRONG' as candidate from strong")
def g9(t: Tables) -> DataFrame:
    return _strong(t).select("master_id", F.md5("review").alias("review"), "p_text_pattern", F.col("p_text_v2_positive_candidate").alias("candidate"))


@query(
    "G10_check_expectations",
    f"""with {TYPED_SQL}, expected as (select cast(row_no as varchar) as master_id, case when n_chars > 1500 then 'NETWORK_STRONG' else 'TEXT_STRONG' end as expected from master)
select e.master_id, expected, coalesce(t.diagnostic_type, 'MISSING') as observed from expected e left join typed t on cast(t.row_no as varchar) = e.master_id where expected is distinct from t.diagnostic_type""",
)
def g10(t: Tables) -> DataFrame:
    """Every labelled document has an expectation; those never diagnosed are missing."""
    expected = t.master().select(
        F.col("row_no").cast("string").alias("master_id"),
        F.when(F.col("n_chars") > 1500, "NETWORK_STRONG").otherwise("TEXT_STRONG").alias("expected"),
    )
    return diagnosis.check_expectations(_typed(t), expected, "diagnostic_type")


@query(
    "G11_type_summary",
    f"""with {TYPED_SQL} select v.diagnostic_type, count(t.master_id) as rows, round(count(t.master_id) * 100.0::double / (select count(*) from typed), 6) as percent
from (values ('TEXT_STRONG'), ('TEXT_WEAK'), ('NETWORK_STRONG'), ('TOTAL')) v(diagnostic_type) left join typed t on v.diagnostic_type in ('TOTAL', t.diagnostic_type) group by 1""",
)
def g11(t: Tables) -> DataFrame:
    return diagnosis.type_summary(_typed(t)).withColumn("percent", r6("percent"))


@query(
    "G11_pattern_summary",
    f"""with {STRONG_SQL} select v.p as p_text_pattern, count(s.master_id) as rows, round(count(s.master_id) * 100.0::double / (select count(*) from strong), 6) as percent,
  case when v.p <> 'TOTAL' then v.p <> 'AMBIGUOUS_TEXT_STRONG' end as candidate
from (values {', '.join(f"('{p}')" for p in (*C.PATTERNS, 'TOTAL'))}) v(p) left join strong s on v.p in ('TOTAL', s.pattern) group by 1""",
)
def g11b(t: Tables) -> DataFrame:
    return diagnosis.pattern_summary(_strong(t)).withColumn("percent", r6("percent"))


@query(
    "G12_samples",
    f"""with {TYPED_SQL} select diagnostic_type, master_id, row_number() over (partition by diagnostic_type order by row_no) as sample_no,
  case when length(review) > 180 then substr(review, 1, 179) || '…' else review end as review from typed qualify sample_no <= 5""",
)
def g12(t: Tables) -> DataFrame:
    rows = _typed(t).withColumn("row_no", text.master_id("master_id").cast("bigint"))
    return diagnosis.samples(rows).select("diagnostic_type", "master_id", big(F.col("sample_no")).alias("sample_no"), "review")


# --- 2.11 model ---------------------------------------------------------------------------------


def _fitted(t: Tables):
    """Splits written once for the several passes of a fit."""
    # Few bytes and much work: as many files as partitions, so that every pass over them has all cores.
    spread = network_signal.spread(scored_splits(t).select("text", "label", "split"), "text")
    splits = materialized(spread, "model-splits")
    return splits, splits.filter(F.col("split") == "train")


@query(
    "X1_fit_and_predict",
    f"with {SPLITS} select md5(text) as text, label, split, true as in_range, true as thresholded from splits",
)
def x1(t: Tables) -> DataFrame:
    """The rows, and that every prediction is a probability and its threshold; the numbers are tested on a closed case."""
    splits, train = _fitted(t)
    predicted = model.predict(model.fit_text_model(train), splits)
    chance = F.col("probability")
    return predicted.select(
        F.md5("text").alias("text"),
        "label",
        "split",
        (~F.isnan(chance) & chance.between(0, 1)).alias("in_range"),
        ((chance >= C.LABEL_THRESHOLD).cast("int") == F.col("predicted")).alias("thresholded"),
    )


@query(
    "X1_optimality",
    f"""with {SPLITS} select c.r as regularization, count(*) as train_rows, c.r = 0.01 as optimal_at_001, c.r = 0.1 as optimal_at_01
from splits, (values (0.01::double), (0.1::double)) c(r) where split = 'train' group by 1""",
)
def x1_optimality(t: Tables) -> DataFrame:
    """Each fit is the minimum of its own loss and not of the other one's; slopes are taken over all training rows."""
    _, train = _fitted(t)
    train = model.hashed(train.select("text", "label"))
    weights = labelled.require_weights(labelled.class_weights(train))
    rows = train.count()
    proved = []
    for fitted_with, fitted in model.fit_text_models(train, (0.01, 0.1), weights).items():
        found = model.optimalities(fitted, train, weights, (0.01, 0.1))
        proved.append((fitted_with, rows, *[model.is_optimal(found[r]) for r in (0.01, 0.1)]))
    schema = "regularization double, train_rows long, optimal_at_001 boolean, optimal_at_01 boolean"
    return t.spark.createDataFrame(proved, schema)


@query(
    "X2_select_model",
    f"""with {SPLITS} select true as best, count(*) filter (label = 0) as normal, count(*) filter (label = 1) as suspicious
from splits where split = 'validation'""",
)
def x2(t: Tables) -> DataFrame:
    """The chosen candidate has the best F1 of all on the whole validation split."""
    splits, train = _fitted(t)
    train = model.hashed(train.select("text", "label"))
    validation_rows = model.hashed(splits.filter(F.col("split") == "validation").select("text", "label"))
    candidates = {f"regularization={r}": fitted for r, fitted in model.fit_text_models(train, (0.01, 0.1)).items()}
    name, chosen = model.select_model(candidates, validation_rows)
    found = {
        key: evaluation.classification_metrics(model.predict(fitted, validation_rows), check=False).first().suspicious_f1
        for key, fitted in candidates.items()
    }
    metrics = evaluation.classification_metrics(model.predict(chosen, validation_rows), check=False)
    return metrics.select(
        F.lit(found[name] == max(found.values())).alias("best"),
        (F.col("tn") + F.col("fp")).alias("normal"),
        (F.col("tp") + F.col("fn")).alias("suspicious"),
    )


@query(
    "X3_evaluate",
    f"""with {SPLITS}, audit as (select sum(n)::bigint as raw_selected, count(*) filter (label = top_label) as kept from grouped)
select count(*) filter (split = 'test' and label = 0) as test_normal, count(*) filter (split = 'test' and label = 1) as test_suspicious,
  count(*) filter (split = 'train' and label = 0) as train_normal, count(*) filter (split = 'train' and label = 1) as train_suspicious,
  round(count(*) filter (split = 'train') / (2 * count(*) filter (split = 'train' and label = 0)), 6) as normal_weight,
  round(count(*) filter (split = 'train') / (2 * count(*) filter (split = 'train' and label = 1)), 6) as suspicious_weight,
  (select raw_selected from audit) as raw_selected, (select kept from audit) as kept, true as cells_add_up from splits""",
)
def x3(t: Tables) -> DataFrame:
    splits, train = _fitted(t)
    row = model.evaluate(model.fit_text_model(train), splits, labelled.prep_audit(selected_rows(t)))
    cells = (F.col("tn") + F.col("fp") == F.col("test_normal")) & (F.col("tp") + F.col("fn") == F.col("test_suspicious"))
    return row.select(
        "test_normal", "test_suspicious", "train_normal", "train_suspicious", r6("normal_weight").alias("normal_weight"),
        r6("suspicious_weight").alias("suspicious_weight"), "raw_selected", "kept", cells.alias("cells_add_up"),
    )


# --- 2.12 streams -------------------------------------------------------------------------------

EVENTS_SQL = """parsed as (select 'j' || user_id as job, event_id as seq, value as v, user_id, ts, event_type as kind,
  event_type in ('purchase','error') and value < 60 as ends, trunc(value)::bigint as iv from events),
ev as (select *, case when ends or kind = 'view' then 'review' when kind = 'signup' and v > 100 then 'rate_limited' when kind = 'click' then 'progress'
  when kind = 'purchase' then 'done' when kind = 'error' then 'error' else 'heartbeat' end as event from parsed),
decoded as (select *, case when event = 'rate_limited' then null when v < 0.3 then 'not_json_or_wrong_type' when v < 0.6 and event <> 'heartbeat' then 'contract_violation' end as violation from ev),
valid as (select *, event = 'review' and violation is null as is_review, event = 'progress' and violation is null as is_progress, violation is not null or event in ('done','error') as is_end from decoded),
ends as (select job, min(seq) as end_seq from valid where is_end group by 1),
live as (select v.*, end_seq from valid v left join ends using (job) where end_seq is null or seq < end_seq)"""


@query(
    "W1_decode_events",
    f"""with {EVENTS_SQL} select job, seq, case when violation is not null then 'violation' when event = 'rate_limited' then 'unknown' else event end as kind,
  case when is_review then 'r' || seq end as review_id, case when violation is null and event in ('progress','done') then iv end as collected,
  case when is_progress and v > 50 then iv end as target, case when violation is null and event = 'error' then v > 20 end as retryable from valid""",
)
def w1(t: Tables) -> DataFrame:
    decoded = stream_events.decode_events(t.job_events())
    kind = (
        F.when(F.col("violation").isNotNull(), "violation").when(F.col("unknown").isNotNull(), "unknown").otherwise(F.col("event"))
    )
    return decoded.select(
        "job", "seq", kind.alias("kind"), F.col("review.review_id").alias("review_id"),
        F.coalesce("progress.collected", "done.collected").alias("collected"), F.col("progress.target").alias("target"),
        F.col("error.retryable").alias("retryable"),
    )


@query("W2_event_violations", f"with {EVENTS_SQL} select job, seq, event, violation, 502 as status from valid where violation is not null")
def w2(t: Tables) -> DataFrame:
    return stream_events.event_violations(stream_events.decode_events(t.job_events())).drop("data")


PROGRESS_SQL = f"""{EVENTS_SQL}, steps as (select job, seq, count(*) filter (is_review) over w as collected,
  last_value(case when is_progress then struct_pack(job_id := job, target := case when v > 50 then iv end) end ignore nulls) over w as report
  from live where is_review or is_progress window w as (partition by job order by seq rows unbounded preceding))"""


@query("W3_job_progress", f"with {PROGRESS_SQL} select job, seq, report.job_id as job_id, collected, report.target as target from steps")
def w3(t: Tables) -> DataFrame:
    return jobs.job_progress(jobs.decoded_once(t.job_events()))


OUTCOME_SQL = f"""{EVENTS_SQL}, jobs_seen as (select distinct job from valid),
collected as (select job, count(*) filter (is_review) as n, max(case when is_progress then job end) as progress_job from live group by 1),
ended as (select v.* from valid v join ends on ends.job = v.job and ends.end_seq = v.seq),
outcomes as (select j.job, coalesce(case when e.violation is null and e.event in ('done','error') then j.job end, progress_job) as job_id,
  case when e.violation is null and e.event = 'done' and coalesce(n, 0) > 0 then 'complete' else 'error' end as outcome,
  case when e.job is null then 504 when e.violation is not null then 502 when e.event = 'done' then case when coalesce(n, 0) > 0 then 200 else 404 end when e.v > 20 then 504 else 502 end as status,
  coalesce(n, 0) as collected, case when e.violation is not null then e.violation when e.event = 'error' then 'failed' end as detail, e.job is not null as ended
  from jobs_seen j left join collected c using (job) left join ended e using (job))"""


@query("W4_job_outcomes", f"with {OUTCOME_SQL} select job, job_id, outcome, status, collected, detail from outcomes")
def w4(t: Tables) -> DataFrame:
    return jobs.job_outcomes(jobs.decoded_once(t.job_events()))


@query(
    "W4_closed_by_source",
    f"""with {OUTCOME_SQL}, users as (select distinct job, user_id from valid)
select job, case when not ended and user_id % 2 = 0 then 502 else status end as status, outcome from outcomes join users using (job)""",
)
def w4c(t: Tables) -> DataFrame:
    """Of the jobs without an end event, those of even users were closed by their source."""
    decoded = jobs.decoded_once(t.job_events())
    closed = t.events().filter(F.col("user_id") % 2 == 0).select(F.concat(F.lit("j"), "user_id").alias("job"))
    return jobs.job_outcomes(decoded, closed).select("job", "status", "outcome")


def _run_stream(t: Tables) -> DataFrame:
    """The stored events as a file stream through the stateful job tracker."""
    folder = f"{shared_folder(t.spark)}/jobs-{pd.Timestamp.now().value}"
    t.job_events().select("job", "seq", "event", "data").write.parquet(f"{folder}/in")
    from trustscore.schemas import JOB_EVENT

    stream = t.spark.readStream.schema(JOB_EVENT).parquet(f"{folder}/in")
    run = (
        jobs.follow_jobs(stream_events.decode_events(stream))
        .writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state")
        # Available-now would wait for the silence timers, ten minutes after the last event.
        .trigger(once=True).start(f"{folder}/out")
    )
    run.awaitTermination()
    return t.spark.read.parquet(f"{folder}/out")


@query("W4_stream_outcomes", f"with {OUTCOME_SQL} select job, job_id, outcome, status, collected, detail from outcomes where ended")
def w4b(t: Tables) -> DataFrame:
    finals = _run_stream(t).filter(F.col("kind").isin("complete", "error"))
    return finals.select("job", "job_id", F.col("kind").alias("outcome"), "status", "collected", "detail")


@query("W3_stream_progress", f"with {PROGRESS_SQL} select job, seq, report.job_id as job_id, collected, report.target as target from steps")
def w3b(t: Tables) -> DataFrame:
    return _run_stream(t).filter(F.col("kind") == "progress").select("job", "seq", "job_id", "collected", "target")


@query(
    "W5_analyze_completed",
    f"""with {OUTCOME_SQL}, done_jobs as (select job from outcomes where outcome = 'complete')
select job, count(*) as reviews, min('r' || seq) as first_review, max('r' || seq) as last_review, count(*) > 1 as compared from live join done_jobs using (job) where is_review group by 1""",
)
def w5(t: Tables) -> DataFrame:
    decoded = jobs.decoded_once(t.job_events())
    outcomes = jobs.job_outcomes(decoded)
    store = jobs.job_reviews(jobs.live_events(decoded))
    flat = jobs.analyze_completed(store, outcomes, analyze_flat)
    return flat.groupBy("job").agg(
        F.count("*").alias("reviews"), F.min("review_id").alias("first_review"), F.max("review_id").alias("last_review"),
        F.bool_and(F.col("network_score") >= 0).alias("compared"),
    )


@query(
    "W6_job_silences",
    f"""with {EVENTS_SQL}, gaps as (select job, lag(seq) over w as last_seq, lag(ts) over w as last_ts, ts from valid window w as (partition by job order by seq))
select job, min(last_seq) as last_seq, 504 as status from gaps where last_ts + interval 36000 second < ts group by 1""",
)
def w6(t: Tables) -> DataFrame:
    return jobs.first_silences(t.job_events(), 36_000)


SPELLS_SQL = f"""{EVENTS_SQL}, marked as (select *, coalesce(ts > lag(ts) over w + interval 36000 second, true) as opens from valid window w as (partition by job order by ts)),
numbered as (select *, count(*) filter (opens) over (partition by job order by ts) as spell from marked),
spells as (select job, min(ts) as started, max(ts) as stopped, arg_max(seq, struct_pack(ts := ts, seq := seq)) as last_seq, count(*) as events,
  case when not bool_or(event in ('done', 'error')) then 504 end as status from numbered group by job, spell)"""


@query("W6_activity_spells", f"with {SPELLS_SQL} select * from spells")
def w6s(t: Tables) -> DataFrame:
    return jobs.activity_spells(t.job_events(), 36_000, F.col("event").isin("done", "error"))


@query(
    "W6_stream_spells",
    f"with {SPELLS_SQL} select * from spells where stopped + interval 36000 second <= (select date_trunc('milliseconds', max(ts)) from valid)",
)
def w6b(t: Tables) -> DataFrame:
    """The stored events as a file stream; spells whose silence has passed when the input ends, silent jobs included."""
    folder = f"{shared_folder(t.spark)}/spells-{pd.Timestamp.now().value}"
    stored = t.job_events().select("job", "seq", "event", F.col("received_at").cast("timestamp").alias("received_at"))
    stored.write.parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(stored.schema).parquet(f"{folder}/in").withWatermark("received_at", "0 seconds")
    run = (
        jobs.activity_spells(stream, 36_000, F.col("event").isin("done", "error"))
        .writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start(f"{folder}/out")
    )
    run.awaitTermination()
    # Back to clock times without a zone, as the table has them.
    clock = {name: F.col(name).cast("timestamp_ntz") for name in ("started", "stopped")}
    return t.spark.read.parquet(f"{folder}/out").withColumns(clock)


@query(
    "W5_sink_replay",
    f"""with {OUTCOME_SQL}, done_jobs as (select job from outcomes where outcome = 'complete')
select job, count(*) as reviews, count(distinct seq) as different, 1 as batches from live join done_jobs using (job) where is_review group by 1""",
)
def w5b(t: Tables) -> DataFrame:
    """The sink fed with every outcome three times: a batch, its retry, and a replay under another number."""
    decoded = jobs.decoded_once(t.job_events())
    store = jobs.job_reviews(jobs.live_events(decoded))
    folder = f"{shared_folder(t.spark)}/scored-{pd.Timestamp.now().value}"
    sink = jobs.completed_sink(lambda: store, analyze_flat, folder)
    finals = jobs.job_outcomes(decoded).select("job", F.col("outcome").alias("kind"))
    for batch in (0, 0, 1):
        sink(finals, batch)
    return t.spark.read.parquet(folder).groupBy("job").agg(
        F.count("*").alias("reviews"), F.count_distinct("review_id").alias("different"),
        F.count_distinct("batch_id").cast("int").alias("batches"),
    )


@query(
    "W7_dedup_reviews",
    f"""with {EVENTS_SQL} select job, count(*) + count(*) filter (event = 'review' and not is_review) as events, count(*) filter (is_review) as reviews from valid group by 1""",
)
def w7(t: Tables) -> DataFrame:
    """Every review event delivered twice, the second time under a later number; one without a valid review stays twice."""
    events = t.job_events()
    again = events.filter(F.col("event") == "review").withColumn("seq", F.col("seq") + 1_000_000_000_000)
    decoded = stream_events.decode_events(events.unionByName(again))
    return (
        stream_events.dedup_reviews(decoded)
        .groupBy("job")
        .agg(F.count("*").alias("events"), F.count_if(F.col("review").isNotNull()).alias("reviews"))
    )


@query("W8_forwardable", f"with {EVENTS_SQL} select event, count(*) as events from valid where violation is null and event <> 'rate_limited' group by 1")
def w8(t: Tables) -> DataFrame:
    decoded = stream_events.decode_events(t.job_events())
    return stream_events.forwardable(decoded).groupBy("event").agg(F.count("*").alias("events"))
