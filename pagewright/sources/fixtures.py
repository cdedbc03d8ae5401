"""Document-block inputs derived from the driver tables, and the same as DuckDB views for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).selectExpr(
        "doc_id * 1000 + line_no div 60 as page_key", "cast(line_no % 60 as int) as block_no", "cast(72 + 6 * (doc_id % 3) as double) as x0",
        "cast(72 + 11 * (line_no % 60) as double) as y0", "cast(72 + 6 * (doc_id % 3) + 6 * least(char_length(line), 80) as double) as x1",
        "cast(82 + 11 * (line_no % 60) as double) as y1", "line as text")


def words(spark: SparkSession, d: str) -> DataFrame:
    w = load(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("wn", "w"))
    before = "sum(char_length(w) + 1) over (partition by conv_id, turn order by wn rows between unbounded preceding and 1 preceding)"
    w = w.selectExpr("conv_id as page_key", "turn as block_no", "cast(wn div 12 as int) as line_no", "wn as word_no", "w as word",
        f"cast(6 * coalesce({before}, 0) + 60 * (wn div 7) as double) as x0", "cast(char_length(w) * 6 as double) as wd", "cast((conv_id * 31 + turn * 17 + wn * 13) % 101 as int) as conf")
    return w.selectExpr("*", "x0 + wd as x1", "cast(72 + 12 * line_no as double) as y0", "cast(72 + 12 * line_no + 8 + word_no % 5 as double) as y1")


def technical(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").selectExpr("p_partkey", """concat('Part ', p_name, ' weighs ', p_size, ' kg, torque ', p_size * 2, ' kPa; ref AB', p_size, ' see https://ex.com/p/', p_partkey,
        ' or u', p_partkey, '@ex.com on 2024/01/', 1 + p_size % 28, ' ........ ', p_partkey) as text""")


LLM = ["o_orderkey % 4 as llm_candidates", "o_orderkey % 2 as llm_changed", "case when o_orderkey % 4 = 3 then 1 else 0 end as llm_rejected"]


def output_pages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").selectExpr("o_orderkey as page", "concat(case when o_orderkey % 50 = 1 then 'seen ZXQENTX0001ZXQ ' when o_orderkey % 50 = 2 then 'zxGLOS12 ' else '' end, o_orderpriority) as text")


def page_log(spark: SparkSession, d: str) -> DataFrame:
    o, li = load(spark, d, "orders"), load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    per = li.groupBy("l_orderkey").agg(F.count_if(F.col("l_linenumber") == 1).alias("changed_blocks"), F.count_if(F.col("l_linenumber") != 1).alias("unchanged_blocks"), (F.sum("l_quantity") * 3).cast("bigint").alias("native_char_count"))
    status = F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "F", "ok_no_text").otherwise("fallback")
    errors = F.when(F.col("o_orderpriority") == "1-URGENT", 1 + F.col("o_orderkey") % 5).otherwise(0)
    return o.select(F.col("o_orderkey").alias("page"), status.alias("status"), (F.col("o_orderkey") % 6).alias("n_warnings"), errors.cast("bigint").alias("n_errors"), *[F.expr(x) for x in LLM]).join(per, F.col("page") == F.col("l_orderkey")).drop("l_orderkey")


def memory(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "conversations").where("conv_id % 2 = 0").groupBy("text").agg(F.min("conv_id").alias("c"))
    return m.selectExpr("'dummy' as provider", "'en' as source_lang", "'pb' as target_lang", "sha2(text, 256) as text_hash", "text as src_text", "case when c % 10 = 0 then concat('ZXQENTX0000ZXQ ', text) else lower(text) end as translated_text")


def attempts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").selectExpr("user_id as run_id", "ts", "event_id", "event_type = 'error' as failed")


def rects(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").selectExpr("l_orderkey as page_key", "l_linenumber as n", "l_partkey", "l_suppkey", "l_quantity", "case when l_linenumber % 2 = 1 then 'native' else 'ocr' end as source",
        "cast((l_partkey * 7) % 80 as double) as x0", "cast((l_suppkey * 11) % 80 as double) as y0", "cast((l_partkey * 7) % 80 + 20 + l_quantity as double) as x1", "cast((l_suppkey * 11) % 80 + 20 + l_quantity as double) as y1")


#: The same in DuckDB, as common table expressions.
SQL = {
    "lines": "select doc_id, i as line_no, string_split(text, chr(10))[i + 1] as line from documents, unnest(range(len(string_split(text, chr(10))))) t(i)",
    "blocks": "select doc_id * 1000 + line_no // 60 as page_key, cast(line_no % 60 as int) as block_no, cast(72 + 6 * (doc_id % 3) as double) as x0, cast(72 + 11 * (line_no % 60) as double) as y0, cast(72 + 6 * (doc_id % 3) + 6 * least(length(line), 80) as double) as x1, cast(82 + 11 * (line_no % 60) as double) as y1, line as text from lines",
    "words": "select *, x0 + wd as x1, cast(72 + 12 * line_no as double) as y0, cast(72 + 12 * line_no + 8 + word_no % 5 as double) as y1 from (select conv_id as page_key, turn as block_no, cast(wn // 12 as int) as line_no, cast(wn as int) as word_no, w as word, cast(6 * coalesce(sum(length(w) + 1) over (partition by conv_id, turn order by wn rows between unbounded preceding and 1 preceding), 0) + 60 * (wn // 7) as double) as x0, cast(length(w) * 6 as double) as wd, cast((conv_id * 31 + turn * 17 + wn * 13) % 101 as int) as conf from (select conv_id, turn, unnest(range(len(string_split(text, ' ')))) as wn, unnest(string_split(text, ' ')) as w from conversations))",
    "technical": "select p_partkey, 'Part ' || p_name || ' weighs ' || p_size || ' kg, torque ' || p_size * 2 || ' kPa; ref AB' || p_size || ' see https://ex.com/p/' || p_partkey || ' or u' || p_partkey || '@ex.com on 2024/01/' || (1 + p_size % 28) || ' ........ ' || p_partkey as text from part",
    "page_log": "select o_orderkey as page, case o_orderstatus when 'O' then 'ok' when 'F' then 'ok_no_text' else 'fallback' end as status, o_orderkey % 6 as n_warnings, cast(case when o_orderpriority = '1-URGENT' then 1 + o_orderkey % 5 else 0 end as bigint) as n_errors, " + ", ".join(LLM) + ", count(*) filter (where l_linenumber = 1) as changed_blocks, count(*) filter (where l_linenumber <> 1) as unchanged_blocks, cast(sum(l_quantity) * 3 as bigint) as native_char_count from orders join lineitem on l_orderkey = o_orderkey group by all",
    "output_pages": "select o_orderkey as page, concat(case when o_orderkey % 50 = 1 then 'seen ZXQENTX0001ZXQ ' when o_orderkey % 50 = 2 then 'zxGLOS12 ' else '' end, o_orderpriority) as text from orders",
    "memory": "select 'dummy' as provider, 'en' as source_lang, 'pb' as target_lang, sha256(text) as text_hash, text as src_text, case when min(conv_id) % 10 = 0 then 'ZXQENTX0000ZXQ ' || text else lower(text) end as translated_text from conversations where conv_id % 2 = 0 group by text",
    "attempts": "select user_id as run_id, ts, event_id, event_type = 'error' as failed from events",
    "rects": "select l_orderkey as page_key, l_linenumber as n, l_partkey, l_suppkey, l_quantity, case when l_linenumber % 2 = 1 then 'native' else 'ocr' end as source, cast((l_partkey * 7) % 80 as double) as x0, cast((l_suppkey * 11) % 80 as double) as y0, cast((l_partkey * 7) % 80 + 20 + l_quantity as double) as x1, cast((l_suppkey * 11) % 80 + 20 + l_quantity as double) as y1 from lineitem",
}


def with_inputs(sql: str) -> str:
    """The statement after the inputs that it names."""
    import re

    chosen: list[str] = []

    def need(text: str) -> None:
        for name, body in SQL.items():
            if name not in chosen and re.search(rf"\b(from|join) {name}\b", text):
                need(body)
                chosen.append(name)

    need(sql)
    head = ", ".join(f"{n} as ({SQL[n]})" for n in chosen)
    if not head:
        return sql
    return f"with {head}, {sql.strip()[5:]}" if sql.strip().lower().startswith("with ") else f"with {head} {sql}"
