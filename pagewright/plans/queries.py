"""Registered queries over the driver tables and, where SQL can express them, the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import geometry as G
from ..functions import text as T
from ..functions import tokens as K
from ..operators import blocks as B
from ..operators import memory as M
from ..operators import packing as P
from ..operators import qa as Q
from ..operators import translation as O
from ..sources import fixtures as S
from ..sources.fixtures import with_inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_inputs(sql)
        return f

    return add


def literal(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(rows, names)


#: clean_text in DuckDB, of a column `raw`.
CLEAN_SQL = r"""
  stripped as (select *, list_filter(list_transform(string_split(replace(coalesce(raw, ''), chr(13), ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ls from src),
  merged as (select *, regexp_replace(array_to_string(ls, chr(10)), '-\n(\p{Ll})', '\1', 'g') as m,
    len(ls) >= 2 and (len(list_filter(ls, lambda x: regexp_matches(x, '(?:\.\s*){5,}'))) >= 1 or len(list_filter(ls, lambda x: regexp_matches(x, '(?i)\s+(?:\d+|[ivxlcdm]+)\s*$'))) >= 2) as toc from stripped),
  cleaned as (select *, case when toc then regexp_replace(array_to_string(list_transform(string_split(m, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), chr(10)), '^\s+|\s+$', '', 'g')
    else regexp_replace(regexp_replace(regexp_replace(replace(m, chr(10), ' '), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\s+([,.;:!?])', '\1', 'g') end as clean from merged)"""

# -- scans and pages


@query("scan_documents", "select doc_id, source, n_chars from documents where lang = 'en'")
def _(spark, d):
    return S.load(spark, d, "documents").where("lang = 'en'").select("doc_id", "source", "n_chars")


@query("page_range", "select page, status from page_log where page >= greatest(0, least(100, 1000000)) and page < least(5000, 1000000)")
def _(spark, d):
    start, end, total = 100, 5000, 1_000_000
    if end <= start:
        raise ValueError("the page range is empty")
    return S.page_log(spark, d).where(F.col("page").between(max(0, min(start, total)), min(end, total) - 1)).select("page", "status")


PAGE_TYPE_SQL = r"select page_id, length(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s', '', 'g')) as n_chars, page_id % 3 > 0 as has_images from pages"


def page_features(spark, d):
    text = F.regexp_replace(F.regexp_replace("html", "<[^>]+>", ""), r"\s", "")
    return S.load(spark, d, "pages").select("page_id", F.char_length(text).alias("n_chars"), (F.col("page_id") % 3 > 0).alias("has_images"))


@query("page_type", f"select *, case when n_chars >= 40 and has_images then 'hybrid' when n_chars >= 40 then 'native' else 'scanned' end as page_type from ({PAGE_TYPE_SQL})")
def page_type(spark, d, least=40):
    native = F.col("n_chars") >= least
    return page_features(spark, d).withColumn("page_type", F.when(native & F.col("has_images"), "hybrid").when(native, "native").otherwise("scanned"))


@query("ocr_route", f"select page_id, case when n_chars < 40 then 'full_ocr' when has_images then 'masked_ocr' else 'native' end as route, case when n_chars >= 40 and not has_images then 'ocr_skipped_no_images' end as warning from ({PAGE_TYPE_SQL})")
def _(spark, d):
    kind = F.col("page_type")
    return page_type(spark, d).select("page_id", F.when(kind == "scanned", "full_ocr").when(kind == "hybrid", "masked_ocr").otherwise("native").alias("route"), F.when(kind == "native", "ocr_skipped_no_images").alias("warning"))


@query("link_filter", "select page, page % 60 - 5 as target from page_log where page % 60 - 5 >= 0 and page % 60 - 5 < 40")
def _(spark, d):
    return S.page_log(spark, d).select("page", (F.col("page") % 60 - 5).alias("target")).where("target >= 0 and target < 40")


@query("merge_pages", "select page, cast(row_number() over (order by page) as bigint) as out_page from page_log where status like 'ok%'")
def _(spark, d):
    # Positions in page order: counts of the pages of lower ranges, then order within a range, so that no task gets all pages.
    pages = S.page_log(spark, d).where(F.col("status").startswith("ok")).select("page", F.expr("page div 4096").alias("part"))
    before = pages.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = pages.withColumn("r", F.row_number().over(W.partitionBy("part").orderBy("page")))
    return ranked.join(before, "part").select("page", (F.col("before") + F.col("r")).alias("out_page"))


@query("resume_pages", "select page from page_log where not (status like 'ok%' and page % 2 = 0)")
def _(spark, d):
    log = S.page_log(spark, d)
    done = log.where((F.col("page") % 2 == 0) & F.col("status").startswith("ok")).select("page")
    return log.join(done, "page", "left_anti").select("page")


@query("file_signature")
def _(spark, d):
    f = spark.read.format("binaryFile").load(f"{d}/region.parquet")
    head, tail = F.substring("content", 1, 65536), F.when(F.col("length") > 65536, F.expr("substring(content, -65536, 65536)")).otherwise(F.lit(b""))
    stamp = F.concat(F.col("length").cast("string"), F.lit("|"), F.unix_timestamp("modificationTime").cast("string")).cast("binary")
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2(F.concat(stamp, head, tail), 256).alias("signature"))


# -- text


@query("text_hash", "select doc_id, sha256(text) as text_hash from documents")
def _(spark, d):
    return S.load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query("clean_text", f"with src as (select doc_id, text as raw from documents), {CLEAN_SQL} select doc_id, clean from cleaned")
def _(spark, d):
    return S.load(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query("toc_like", f"with src as (select doc_id, text as raw from documents), {CLEAN_SQL} select doc_id, toc from cleaned")
def _(spark, d):
    return S.load(spark, d, "documents").select("doc_id", T.toc_like(T.clean_lines(F.col("text"))).alias("toc"))


@query("dehyphenate", r"select doc_id, regexp_replace(replace(text, ' ', '-' || chr(10)), '-\n(\p{Ll})', '\1', 'g') as joined from documents")
def _(spark, d):
    return S.load(spark, d, "documents").select("doc_id", T.dehyphenate(F.replace("text", F.lit(" "), F.lit("-\n"))).alias("joined"))


POST_SQL = r"""select p_partkey, array_to_string(list_transform(string_split(t, chr(10)), lambda l: case
  when len(regexp_extract_all(l, '\.')) >= 10 and regexp_matches(l, '(?:\.\s){5,}|\.{10,}') then regexp_replace(l, '\s+$', '')
  else trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '\s+([,.;:!?])', '\1', 'g'), '([,.;:!?])([A-Za-zÀ-ÖØ-öø-ÿ])', '\1 \2', 'g'), '\s+%', '%', 'g'), '[ \t]{2,}', ' ', 'g')) end), chr(10)) as done
  from (select p_partkey, replace(text, ';', ' ;') || chr(10) || p_partkey || ' %  a .b' || chr(10) || 'x ............ 9  ' as t from technical)"""


@query("postprocess", POST_SQL)
def _(spark, d):
    t = S.technical(spark, d).select("p_partkey", F.expr("concat(replace(text, ';', ' ;'), '\n', p_partkey, ' %  a .b', '\n', 'x ............ 9  ')").alias("t"), "text")
    return t.select("p_partkey", T.postprocess(F.col("t"), F.col("text")).alias("done"))


@query("block_short", r"""select page_key, block_no, case when length(s) > 40 then substr(s, 1, 39) || '…' else s end as label from
  (select *, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') as s from blocks)""")
def _(spark, d):
    return S.blocks(spark, d).select("page_key", "block_no", T.short(F.col("text"), 40).alias("label"))


LANGS = [("en-US",), ("pt_BR",), (" PB ",), ("pt-BR",), ("PTBRasil",), ("de",), ("",), ("fr_CA",), ("pt",), ("zh-Hant-TW",)]
LANG_SQL = "(select lang, replace(lower(trim(lang)), '_', '-') as c from (values " + ", ".join(f"('{x}')" for (x,) in LANGS) + ") t(lang))"
CODE_SQL = "case when c in ('pb', 'pt-br', 'ptbr', 'ptbrasil') then 'pb' else split_part(c, '-', 1) end"


@query("lang_normalize", f"select lang, {CODE_SQL} as code from {LANG_SQL}")
def _(spark, d):
    return literal(spark, LANGS, "lang string").select("lang", T.normalize_lang(F.col("lang")).alias("code"))


@query("provider_lang", f"select lang, provider, case when code <> 'pb' then code when provider = 'mymemory' then 'pt-br' when provider = 'translategemma' then 'pt-BR' else 'pt' end as used from (select lang, {CODE_SQL} as code from {LANG_SQL}), (values ('mymemory'), ('translategemma'), ('libretranslate'), ('opusmt')) p(provider)")
def _(spark, d):
    both = literal(spark, [(x, p) for (x,) in LANGS for p in ("mymemory", "translategemma", "libretranslate", "opusmt")], "lang string, provider string")
    return both.select("lang", "provider", T.provider_lang(F.col("provider"), F.col("lang")).alias("used"))


RULES = [("O projecto actual", "O projeto atual"), ("ACTUALMENTE de facto", "ATUALMENTE de facto"), ("Factos e contactos da Equipa", "Fatos e contatos da Equipe"), ("optimização e Optimizar", "otimização e Otimizar"), ("ZXQENTX0000ZXQ actual", "ZXQENTX0000ZXQ atual")]


@query("ptbr_rules", "select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in RULES) + ") t(src, dst)")
def _(spark, d):
    return literal(spark, [(a,) for a, _ in RULES], "src string").select("src", T.ptbr(F.col("src")).alias("dst"))


@query("hard_split", "select doc_id, i as part, substr(text, i * 500 + 1, 500) as piece from documents, unnest(range(greatest(1, cast(ceil(length(text) / 500.0) as int)))) t(i)")
def _(spark, d):
    return S.load(spark, d, "documents").select("doc_id", F.posexplode(T.hard_split(F.col("text"), 500)).alias("part", "piece"))


CHUNK_SQL = r"""with recursive src as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from documents),
  sent as (select doc_id, t, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as s from src),
  fold as (select doc_id, s, 1 as i, cast([] as varchar[]) as done, '' as cur from sent where length(t) > 400
    union all select doc_id, s, i + 1, case when cur <> '' and length(cur) + 1 + length(s[i]) > 400 then list_append(done, cur) else done end,
      case when cur = '' then s[i] when length(cur) + 1 + length(s[i]) <= 400 then cur || ' ' || s[i] else s[i] end from fold where i <= len(s)),
  runs as (select doc_id, list_append(done, cur) as r from fold where i = len(s) + 1 union all select doc_id, [t] from sent where length(t) <= 400),
  flat as (select doc_id, ri, r[ri] as x from runs, unnest(range(1, len(r) + 1)) u(ri)),
  cut as (select doc_id, ri, k, substr(x, k * 400 + 1, 400) as chunk from flat, unnest(range(greatest(1, cast(ceil(length(x) / 400.0) as int)))) v(k))
  select doc_id, row_number() over (partition by doc_id order by ri, k) - 1 as n, chunk from cut"""


@query("chunk_text", CHUNK_SQL)
def _(spark, d):
    return S.load(spark, d, "documents").select("doc_id", F.posexplode(T.chunk_text(F.col("text"), 400)).alias("n", "chunk"))


# -- placeholder tokens

ENT_SQL = {m: C.ENTITIES[m].replace("'", "''") for m in ("default", "relaxed")}


def _entity_sql(mode: str) -> str:
    return f"""select p_partkey, array_to_string(list_transform(m, lambda x, i: g[i] || 'ZXQENTX' || lpad(cast(i - 1 as varchar), 4, '0') || 'ZXQ'), '') || g[len(m) + 1] as protected, array_to_string(m, '|') as found
  from (select p_partkey, regexp_extract_all(text, '{ENT_SQL[mode]}') as m, string_split(regexp_replace(text, '{ENT_SQL[mode]}', chr(1), 'g'), chr(1)) as g from technical)"""


def _entities(mode):
    def run(spark, d):
        text, mapping = K.protect_entities(F.col("text"), "", mode)
        return S.technical(spark, d).select("p_partkey", text.alias("protected"), F.array_join(F.map_values(mapping), "|").alias("found"))

    return run


for _mode in ("default", "relaxed"):
    query(f"protect_entities_{_mode}", _entity_sql(_mode))(_entities(_mode))


def _round_trip(restore, damage):
    def run(spark, d):
        text, mapping = K.protect_entities(F.col("text"), "b001_s001_", "default")
        t = S.technical(spark, d).select("p_partkey", "text", text.alias("sent"), mapping.alias("map"))
        return t.select("p_partkey", restore(damage(F.col("sent")), F.col("map")).alias("restored"), "text")

    return run


BACK_SQL = "select p_partkey, text as restored, text from technical"
query("restore_exact", BACK_SQL)(_round_trip(K.restore_exact, lambda c: F.regexp_replace(c, "ZXQENT", "zxqent")))
query("restore_fuzzy", BACK_SQL)(_round_trip(K.restore_fuzzy, lambda c: F.regexp_replace(c, "ZXQENT", "ZXXQENT")))
query("restore_spaced", BACK_SQL)(_round_trip(K.restore_spaced, lambda c: F.regexp_replace(c, "ZXQENTB001S001X", "Z X Q ENT B001S001 X ")))


@query("dnt_protect", "select p_partkey, replace(text, 'ref', 'ZXQENTX0000ZXQ') as protected, 'ref' as terms from technical")
def _(spark, d):
    text, mapping = K.protect_terms(F.col("text"), {t: t for t in ("API", "API_KEY", "PDF", "CLI", "ref")}, "ENT")
    return S.technical(spark, d).select("p_partkey", text.alias("protected"), F.array_join(F.map_values(mapping), "|").alias("terms"))


@query("glossary_apply", "select p_partkey, replace(replace(text, 'torque', 'binário'), 'Part', 'Peça') as applied from technical")
def _(spark, d):
    text, mapping = K.protect_terms(F.col("text"), {"Part": "Peça", "torque": "binário", "Figure": "Figura", "Warning": "Aviso"}, "GLOS")
    return S.technical(spark, d).select("p_partkey", K.restore(text, mapping).alias("applied"))


@query("post_edit_guard", """select p_partkey, case p_partkey % 3 when 0 then '' else 'numbers_units_changed' end as reasons from technical""")
def _(spark, d):
    after = F.when(F.col("p_partkey") % 3 == 0, F.replace("text", F.lit("weighs"), F.lit("has"))).otherwise(F.concat("text", F.lit(" and 77 kg")))
    return S.technical(spark, d).select("p_partkey", F.array_join(T.guard(F.col("text"), after), "|").alias("reasons"))


@query("qa_zxq_leak", "select text_hash, regexp_matches(translated_text, '(?i)ZXQ|Z[XQ]{0,4}(?:ENT|GLOS)\\w*\\d') as leak, case when regexp_matches(translated_text, '(?i)ZXQ') then substr(replace(translated_text, chr(10), ' '), 1, 33) end as snippet from memory")
def _(spark, d):
    t = F.regexp_replace("translated_text", "\n", " ")
    before = F.char_length(F.regexp_extract(t, "(?i)^(.*?)ZXQ", 1))
    snippet = F.substring(t, F.greatest(before - 30, F.lit(0)) + 1, F.least(before, F.lit(30)) + 33)
    m = S.memory(spark, d).select("text_hash", F.col("translated_text").rlike(C.LEAK).alias("leak"), F.when(t.rlike("(?i)ZXQ"), snippet).alias("snippet"))
    return m


# -- translation memory and chain


def requests(spark, d):
    c = S.load(spark, d, "conversations").where(T.strip(F.col("text")) != "")
    return c.selectExpr("conv_id", "turn", "'dummy' as provider", "'en' as source_lang", "'pb' as target_lang", "sha2(text, 256) as text_hash", "text as src_text")


TM_SQL = "select c.conv_id, c.turn, m.translated_text from conversations c left join (select * from memory where not regexp_matches(translated_text, '(?i)ZXQ|__ENT_|__GLOS_')) m on sha256(c.text) = m.text_hash"


@query("tm_lookup", TM_SQL)
def _(spark, d):
    return M.lookup(requests(spark, d), S.memory(spark, d)).select("conv_id", "turn", "translated_text")


@query("tm_missing", f"select conv_id, turn from ({TM_SQL}) where translated_text is null")
def _(spark, d):
    return M.missing(requests(spark, d), S.memory(spark, d)).select("conv_id", "turn")


@query("tm_upsert", "select text_hash, src_text, case when length(src_text) % 2 = 0 then 'new' else translated_text end as translated_text from memory")
def _(spark, d):
    old = S.memory(spark, d)
    new = old.where(F.char_length("src_text") % 2 == 0).withColumn("translated_text", F.lit("new"))
    return M.upsert(old, new).select("text_hash", "src_text", "translated_text")


@query("dedupe_scatter", "select conv_id, turn, lower(text) as done from conversations")
def _(spark, d):
    return M.once_each(S.load(spark, d, "conversations"), "text", "done", F.lower).select("conv_id", "turn", "done")


@query("translate_many", f"select conv_id, turn, coalesce(translated_text, text) as translated_text from ({TM_SQL.replace('c.turn,', 'c.turn, c.text,')})")
def _(spark, d):
    def dummy(todo: DataFrame) -> DataFrame:
        text, mapping = K.protect_entities(F.col("src_text"), "b000_s000_", "default")
        sent = todo.select("*", text.alias("sent"), mapping.alias("map"))
        return sent.withColumn("translated_text", K.restore_exact(F.col("sent"), F.col("map")))

    return M.translate_many(requests(spark, d), S.memory(spark, d), dummy).select("conv_id", "turn", "translated_text")


@query("translate_one")
def _(spark, d):
    options = {"glossary": {"table": "quadro"}, "terms": ["API"]}
    return O.translate_one(requests(spark, d), S.memory(spark, d), lambda chunk: chunk, **options).select("conv_id", "turn", "translated_text")


@query("oversize_route", "select conv_id, turn, length(text) > greatest(50, cast(floor(400 * 0.8) as int)) as alone from conversations")
def _(spark, d):
    return S.load(spark, d, "conversations").select("conv_id", "turn", (F.char_length("text") > max(50, int(400 * 0.8))).alias("alone"))


PACK_SQL = """with recursive c as (select conv_id, turn, length(text) as len, row_number() over (partition by conv_id order by turn) as r from conversations),
  f as (select conv_id, r, turn, len + 21 as size, 0 as batch from c where r = 1
    union all select c.conv_id, c.r, c.turn, case when f.size > 0 and f.size + c.len + 21 > 1200 then c.len else f.size + c.len + 21 end, case when f.size > 0 and f.size + c.len + 21 > 1200 then f.batch + 1 else f.batch end
    from f join c on c.conv_id = f.conv_id and c.r = f.r + 1) select conv_id, turn, batch from f"""


@query("batch_pack", PACK_SQL)
def _(spark, d):
    return P.batches(S.load(spark, d, "conversations"), ["conv_id"], ["turn"], "text").select("conv_id", "turn", "batch")


@query("batch_roundtrip", "select conv_id, count(*) as n, true as whole from conversations group by conv_id")
def _(spark, d):
    r = P.joined(S.load(spark, d, "conversations"), ["conv_id"], "turn", "text")
    return r.select("conv_id", "n", (F.size(P.split_reply(F.col("request"))) == F.col("n")).alias("whole"))


RETRY_SQL = r"""(select conv_id, turn, text, length(t) between 12 and 800 and regexp_matches(t, '[A-Za-z]') and not (not regexp_matches(t, '\s') and regexp_matches(t, '^[A-Za-z0-9_\-.]+$') and length(t) <= 10)
  and (regexp_matches(' ' || lower(t) || ' ', ' (the|and|of|to|for|with|in|on|from|by) ') or len(regexp_extract_all(t, '[A-Za-z]{2,}')) >= 3) as ok from (select *, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from conversations))"""


@query("retry_candidates", f"select conv_id, turn from (select *, row_number() over (partition by conv_id order by turn) as r from {RETRY_SQL} where ok) where r <= 250")
def retry_candidates(spark, d, most=250):
    c = S.load(spark, d, "conversations").where(T.should_retry(F.col("text")))
    return c.withColumn("r", F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))).where(F.col("r") <= most).select("conv_id", "turn")


@query("retry_merge", f"select conv_id, count(*) as blocks, count(*) filter (where r <= 250 and turn % 2 = 0) as newly_changed from (select *, case when ok then sum(cast(ok as int)) over (partition by conv_id order by turn) end as r from {RETRY_SQL}) group by conv_id")
def _(spark, d):
    again = retry_candidates(spark, d).withColumn("again", F.when(F.col("turn") % 2 == 0, F.lit("new")))
    all_ = S.load(spark, d, "conversations").select("conv_id", "turn", "text").join(again, ["conv_id", "turn"], "left")
    merged = all_.withColumn("done", F.coalesce("again", "text"))
    return merged.groupBy("conv_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("done") != F.col("text")).alias("newly_changed"))


@query("changed_unchanged", r"select conv_id, count(*) filter (where turn % 2 = 0) as changed, count(*) filter (where turn % 2 <> 0) as unchanged from conversations group by conv_id")
def _(spark, d):
    norm = lambda c: F.lower(T.squeeze(c))
    after = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" x"))).otherwise(F.concat(F.lit("  "), F.lower("text")))
    same = norm(F.col("text")) == norm(after)
    return S.load(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(~same).alias("changed"), F.count_if(same).alias("unchanged"))


@query("post_edit_candidates", r"select conv_id, turn from (select *, row_number() over (partition by conv_id order by turn) as r from conversations where length(regexp_replace(text, '^\s+|\s+$', '', 'g')) between 30 and 700) where r <= 30")
def _(spark, d):
    c = S.load(spark, d, "conversations").where(F.char_length(T.strip(F.col("text"))).between(30, 700))
    return c.withColumn("r", F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))).where("r <= 30").select("conv_id", "turn")


REPLIES = [('{"text": "Texto revisado"}', "a"), ("not-json", "original"), ('{"text": "  "}', "kept"), ('{"other": 1}', "same")]


@query("post_edit_parse", "select * from (values ('a', 'Texto revisado'), ('original', 'original'), ('kept', 'kept'), ('same', 'same')) t(src, done)")
def _(spark, d):
    r = literal(spark, REPLIES, "reply string, src string")
    return r.select("src", F.coalesce(F.nullif(T.strip(F.get_json_object("reply", "$.text")), F.lit("")), "src").alias("done"))


CHATS = [('{"choices":[{"message":{"content":"plain"}}]}',), ('{"choices":[{"message":{"content":[{"text":"a"},{"text":"b"}]}}]}',), ('{"choices":[{"text":"old"}]}',)]


@query("chat_extract", "select * from (values ('plain'), ('ab'), ('old')) t(content)")
def _(spark, d):
    j = literal(spark, CHATS, "reply string")
    content = F.get_json_object("reply", "$.choices[0].message.content")
    parts_ = F.array_join(F.transform(F.from_json(content, "array<struct<text:string>>"), lambda p: p["text"]), "")
    return j.select(F.coalesce(F.when(content.startswith("["), parts_).otherwise(content), F.get_json_object("reply", "$.choices[0].text")).alias("content"))


@query("token_budget", "select p_partkey, least(2048, greatest(256, 2 * greatest(1, length(text) // 4))) as budget from technical")
def _(spark, d):
    return S.technical(spark, d).select("p_partkey", F.least(F.lit(2048), F.greatest(F.lit(256), 2 * F.greatest(F.lit(1), F.floor(F.char_length("text") / 4)))).cast("bigint").alias("budget"))


@query("target_prefix", "select p_partkey, '>>por_BR<< ' || text as sent from technical")
def _(spark, d):
    t = F.regexp_replace("text", "^﻿", "")
    return S.technical(spark, d).select("p_partkey", F.when(t.startswith(">>por_BR<<"), t).otherwise(F.concat(F.lit(">>por_BR<< "), t)).alias("sent"))


MODES_SQL = "(select case when o_orderkey % 3 = 0 then 'libretranslate' when o_orderkey % 3 = 1 then 'mymemory' else 'dummy' end as provider, case o_custkey % 7 when 0 then null when 1 then 'auto' when 2 then ' On ' when 3 then 'off' when 4 then 'TRUE' when 5 then 'no' else '0' end as mode, o_orderkey from orders)"


@query("batch_mode", f"select o_orderkey, provider, mode, case when lower(trim(mode)) in ('0', 'false', 'off', 'no') then false when lower(trim(mode)) in ('1', 'true', 'on', 'yes') then true else provider = 'libretranslate' end as batched from {MODES_SQL}")
def _(spark, d):
    rows = S.load(spark, d, "orders").selectExpr("o_orderkey", "case when o_orderkey % 3 = 0 then 'libretranslate' when o_orderkey % 3 = 1 then 'mymemory' else 'dummy' end as provider",
        "case o_custkey % 7 when 0 then null when 1 then 'auto' when 2 then ' On ' when 3 then 'off' when 4 then 'TRUE' when 5 then 'no' else '0' end as mode")
    return rows.withColumn("batched", P.batch_enabled(F.col("provider"), F.col("mode")))


@query("provider_key", "select provider || '|g:' || left(sha256('{}'), 8) || '|dnt:' || left(sha256('[]'), 8) || '|em:relaxed' as key from (values ('dummy'), ('opusmt')) t(provider)")
def _(spark, d):
    short = lambda x: F.left(F.sha2(F.lit(x), 256), F.lit(8))
    return literal(spark, [("dummy",), ("opusmt",)], "provider string").select(F.concat("provider", F.lit("|g:"), short("{}"), F.lit("|dnt:"), short("[]"), F.lit("|em:relaxed")).alias("key"))


@query("config_merge", "select * from (values ('a', '1'), ('b.c', '9'), ('b.d', '3'), ('e', '5')) t(key, value)")
def _(spark, d):
    left, right = {"a": "1", "b.c": "2", "b.d": "3"}, {"b.c": "9", "e": "5"}
    m = lambda x: F.create_map(*[F.lit(v) for kv in x.items() for v in kv])
    mine = F.map_filter(m(left), lambda k, v: ~F.array_contains(F.map_keys(m(right)), k))
    return spark.range(1).select(F.explode(F.map_concat(mine, m(right))).alias("key", "value"))


@query("dnt_load", "select * from (values ('API'), ('CLI'), ('PDF')) t(term)")
def _(spark, d):
    raw = literal(spark, [("# names",), ("API",), ("  CLI ",), ("",), ("PDF",), ("API",)], "line string")
    return raw.select(T.strip(F.col("line")).alias("term")).where("term <> '' and not startswith(term, '#')").distinct()


# -- blocks and geometry


@query("native_blocks", f"with src as (select page_key, block_no, text as raw from blocks), {CLEAN_SQL} select page_key, block_no, clean from cleaned where regexp_replace(raw, '\\s', '', 'g') <> '' and length(clean) >= 5")
def _(spark, d):
    return B.native_blocks(S.blocks(spark, d)).select("page_key", "block_no", "clean")


@query("reading_order", "select page_key, block_no, cast(row_number() over (partition by page_key order by round_even(y0 / 10, 0) * 10, x0, block_no) as int) as rank from blocks")
def _(spark, d):
    return B.reading_order(S.blocks(spark, d), "block_no").select("page_key", "block_no", "rank")


@query("blocks_union", "select source, count(*) as n, sum(n) as ordinals from rects group by source")
def _(spark, d):
    r = S.rects(spark, d)
    return B.union_blocks(r.where("source = 'native'"), r.where("source = 'ocr'")).groupBy("source").agg(F.count("*").alias("n"), F.sum("n").alias("ordinals"))


@query("ocr_words", "select page_key, block_no, word_no from words where conf >= 40 and regexp_replace(word, '\\s', '', 'g') <> ''")
def _(spark, d):
    return S.words(spark, d).where((F.col("conf") >= 40) & (T.strip(F.col("word")) != "")).select("page_key", "block_no", "word_no")


GROUP_SQL = "with good as (select * from words where conf >= 40 and regexp_replace(word, '\\s', '', 'g') <> ''), {g}, src as (select *, t as raw from grouped), " + CLEAN_SQL.strip() + " select {k}, x0, x1, round(conf, 6) as conf, clean as text from cleaned where length(clean) >= 2"
LINE_G = "grouped as (select page_key, block_no, line_no, min(x0) as x0, max(x1) as x1, avg(conf) as conf, string_agg(word, ' ' order by x0, word_no) as t from good group by 1, 2, 3)"
PAR_G = "ln as (select page_key, block_no, line_no, min(x0) as x0, max(x1) as x1, sum(conf) as cs, count(*) as cn, string_agg(word, ' ' order by x0, word_no) as t from good group by 1, 2, 3), grouped as (select page_key, block_no, min(x0) as x0, max(x1) as x1, sum(cs) / sum(cn) as conf, string_agg(t, chr(10) order by line_no) as t from ln group by 1, 2)"


@query("ocr_group_line", GROUP_SQL.replace("{g}", LINE_G).replace("{k}", "page_key, block_no, line_no"))
def _(spark, d):
    return B.ocr_groups(S.words(spark, d), ["page_key", "block_no", "line_no"], False).select("page_key", "block_no", "line_no", "x0", "x1", F.round("conf", 6).alias("conf"), "text")


@query("ocr_group_paragraph", GROUP_SQL.replace("{g}", PAR_G).replace("{k}", "page_key, block_no"))
def _(spark, d):
    return B.ocr_groups(S.words(spark, d), ["page_key", "block_no"], True).select("page_key", "block_no", "x0", "x1", F.round("conf", 6).alias("conf"), "text")


NOISE_SQL = r"""with t as (select conv_id, turn, wn, w, regexp_replace(w, '\s+', '', 'g') as s, len(regexp_extract_all(w, '[A-Za-z]')) as a, len(regexp_extract_all(w, '\d')) as n
    from (select conv_id, turn, unnest(range(len(string_split(text, ' ')))) as wn, unnest(string_split(text, ' ')) as w from conversations))
  select conv_id, turn, wn, length(s) < 2 or a + n = 0 or regexp_matches(s, '^[A-Za-z]{1,2}$|^[A-Za-z]\)$') or ((a + n) / length(s) < 0.30 and a < 4 and n < 2) or ((a + n) / length(s) < 0.35 and a <= 2 and n <= 2) as noise from t"""


@query("ocr_noise", NOISE_SQL)
def _(spark, d):
    w = S.load(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("wn", "w"))
    return w.select("conv_id", "turn", "wn", T.ocr_noise(F.col("w")).alias("noise"))


@query("line_cover", "select page_key, block_no, line_no, min(x0) as x0, max(x1) as x1, max(y1) as y1 from words where regexp_replace(word, '\\s', '', 'g') <> '' group by all")
def _(spark, d):
    return B.line_cover(S.words(spark, d)).select("page_key", "block_no", F.explode("cover").alias("c")).select("page_key", "block_no", "c.line_no", "c.x0", "c.x1", "c.y1")


GAP_SQL = """with h as (select page_key, block_no, line_no, list_sort(list(y1 - y0)) as hs from words where y1 > y0 group by all),
  s as (select w.*, h.hs[len(h.hs) // 2 + 1] as h from words w join h using (page_key, block_no, line_no) where regexp_replace(word, '\\s', '', 'g') <> ''),
  c as (select *, case when x0 - max(x1) over (partition by page_key, block_no, line_no order by {o} rows between unbounded preceding and 1 preceding) > 2.5 * h then 1 else 0 end as cut from s),
  k as (select *, sum(cut) over (partition by page_key, block_no, line_no order by {o} rows unbounded preceding) as cluster from c)
  select page_key, block_no, line_no, cast(cluster as bigint) as cluster, min(x0) as x0, max(x1) as x1, count(*) as n_words, string_agg(word, ' ' order by {o}) as text from k group by 1, 2, 3, 4"""


def _clusters(order):
    def run(spark, d):
        return B.cluster_boxes(B.gap_clusters(S.words(spark, d), order), order)

    return run


query("sparse_split", GAP_SQL.replace("{o}", "x0, y0, word_no"))(_clusters(["x0", "y0", "word_no"]))
query("ocr_cluster", GAP_SQL.replace("{o}", "y0, x0, word_no"))(_clusters(["y0", "x0", "word_no"]))

IOU_SQL = "case when least(a.x1, b.x1) > greatest(a.x0, b.x0) and least(a.y1, b.y1) > greatest(a.y0, b.y0) then ((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) else 0.0 end"


@query("iou", f"select page_key, n, l_partkey, l_suppkey, l_quantity, round({IOU_SQL}, 9) as iou from (select a.page_key, a.n, a.l_partkey, a.l_suppkey, a.l_quantity, a, struct_pack(x0 := 30.0::double, y0 := 30.0::double, x1 := 70.0::double, y1 := 80.0::double) as b from rects a)")
def _(spark, d):
    r = S.rects(spark, d)
    r = r.select("page_key", "n", "l_partkey", "l_suppkey", "l_quantity", *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")], F.lit(30.0).alias("b_x0"), F.lit(30.0).alias("b_y0"), F.lit(70.0).alias("b_x1"), F.lit(80.0).alias("b_y1"))
    return r.select("page_key", "n", "l_partkey", "l_suppkey", "l_quantity", F.round(G.iou("a_", "b_"), 9).alias("iou"))


@query("ocr_dedup_antijoin", f"select page_key, n, l_partkey, l_suppkey, l_quantity from rects a where source = 'ocr' and not exists (select 1 from rects b where b.source = 'native' and b.page_key = a.page_key and {IOU_SQL} >= 0.20)")
def _(spark, d):
    r = S.rects(spark, d)
    return B.drop_duplicates_of_native(r.where("source = 'ocr'"), r.where("source = 'native'")).select("page_key", "n", "l_partkey", "l_suppkey", "l_quantity")


@query("word_spatial_join", "select w.page_key, b.block_no, w.word_no, count(*) as n from words w join (select page_key, block_no, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from words where line_no = 0 group by 1, 2) b on w.page_key = b.page_key and w.x0 < b.x1 and b.x0 < w.x1 and w.y0 < b.y1 and b.y0 < w.y1 group by 1, 2, 3")
def _(spark, d):
    w = S.words(spark, d)
    b = w.where("line_no = 0").groupBy("page_key", "block_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return B.words_in_blocks(w, b).groupBy("page_key", "block_no", "word_no").agg(F.count("*").alias("n"))


@query("ocr_big_bbox", "select page_key, count(*) filter (where (x1 - x0) * (y1 - y0) / 10000 > 0.15) as dropped, count(*) filter (where (x1 - x0) * (y1 - y0) / 10000 <= 0.15) as kept from rects where source = 'ocr' group by page_key")
def _(spark, d):
    big = G.area() / F.greatest(F.lit(1.0), F.lit(10000.0)) > 0.15
    return S.rects(spark, d).where("source = 'ocr'").groupBy("page_key").agg(F.count_if(big).alias("dropped"), F.count_if(~big).alias("kept"))


MODES = [(False, "line", True, "0.5"), (False, "word", True, "0.5"), (True, "line", True, "0.5"), (True, "word", True, "x"), (True, "invalid", True, "0.5"), (False, "line", False, "0.5")]


@query("cover_mode", "select has_images, mode, auto, case when auto and not has_images then 'block' when mode in ('line', 'word', 'block') then mode else 'line' end as cover, case when auto and not has_images then 1.0::double else coalesce(try_cast(ratio as double), 0.5) end as ratio from (values " + ", ".join(f"({str(a).lower()}, '{m}', {str(b).lower()}, '{r}')" for a, m, b, r in MODES) + ") t(has_images, mode, auto, ratio)")
def _(spark, d):
    t = literal(spark, MODES, "has_images boolean, mode string, auto boolean, ratio string")
    simple = F.col("auto") & ~F.col("has_images")
    return t.select("has_images", "mode", "auto", F.when(simple, "block").when(F.col("mode").isin("line", "word", "block"), F.col("mode")).otherwise("line").alias("cover"), F.when(simple, 1.0).otherwise(F.coalesce(F.col("ratio").try_cast("double"), F.lit(0.5))).alias("ratio"))


COVER_SQL = "select page_key, n, l_partkey, l_suppkey, l_quantity, greatest(0, x0 - 0.5) as cx0, greatest(0, y0 - 0.5) as cy0, least(110, x1 + 0.5) as cx1, least(110, y1 + 0.5) as cy1 from rects where source = 'native' and least(110, x1 + 0.5) > greatest(0, x0 - 0.5) and least(110, y1 + 0.5) > greatest(0, y0 - 0.5)"


@query("cover_rects", COVER_SQL)
def _(spark, d, page=110.0, pad=0.5):
    low = lambda c: F.greatest(F.lit(0.0), F.col(c) - pad)
    high = lambda c: F.least(F.lit(page), F.col(c) + pad)
    r = S.rects(spark, d).where("source = 'native'").select("page_key", "n", "l_partkey", "l_suppkey", "l_quantity", low("x0").alias("cx0"), low("y0").alias("cy0"), high("x1").alias("cx1"), high("y1").alias("cy1"))
    return r.where("cx1 > cx0 and cy1 > cy0")


@query("mask_rects", "select page_key, n, l_partkey, l_suppkey, l_quantity, cast(trunc(greatest(0, (x0 - 1) * 2)) as int) as px0, cast(trunc(least(200, (x1 + 1) * 2)) as int) as px1 from rects where least(200, (x1 + 1) * 2) - greatest(0, (x0 - 1) * 2) >= 2")
def _(spark, d, scale=2.0, pad=1.0, width=200.0):
    a, b = F.greatest(F.lit(0.0), (F.col("x0") - pad) * scale), F.least(F.lit(width), (F.col("x1") + pad) * scale)
    return S.rects(spark, d).where(b - a >= 2).select("page_key", "n", "l_partkey", "l_suppkey", "l_quantity", a.cast("int").alias("px0"), b.cast("int").alias("px1"))


COLORS_SQL = "(select i, (i * 37) % 256 as r, (i * 91) % 256 as g, (i * 53) % 256 as b from range(256) t(i))"


def colors(spark):
    return spark.range(256).selectExpr("id as i", "(id * 37) % 256 as r", "(id * 91) % 256 as g", "(id * 53) % 256 as b").withColumn("lum", G.luminance(F.col("r"), F.col("g"), F.col("b")))


@query("text_color", f"select i, case when 0.2126::double * r + 0.7152::double * g + 0.0722::double * b < 140 then 'white' else 'black' end as color from {COLORS_SQL}")
def _(spark, d):
    return colors(spark).select("i", F.when(F.col("lum") < 140, "white").otherwise("black").alias("color"))


@query("bg_color", f"select i, case when lum >= 245 then 255 when lum <= 90 then r when lum >= 200 then cast(trunc(r + (255 - r) * 0.5::double) as bigint) else cast(trunc(r + (255 - r) * 0.5::double * (lum - 90) / 110) as bigint) end as red from (select *, 0.2126::double * r + 0.7152::double * g + 0.0722::double * b as lum from {COLORS_SQL})")
def _(spark, d, alpha=0.5):
    lum, r = F.col("lum"), F.col("r")
    blend = lambda a: (r + (255 - r) * a).cast("bigint")
    return colors(spark).select("i", F.when(lum >= 245, 255).when(lum <= 90, r).when(lum >= 200, blend(F.lit(alpha))).otherwise((r + (255 - r) * F.lit(alpha) * (lum - 90) / 110).cast("bigint")).alias("red"))


@query("font_fit")
def _(spark, d, most=11.0, least=5.0):
    sizes = F.transform(F.sequence(F.lit(0), F.lit(int((most - least) * 2))), lambda i: most - i * 0.5)
    fits = F.filter(sizes, lambda s: F.char_length("text") * s * 0.5 <= F.col("x1") - F.col("x0") + 1)
    return S.blocks(spark, d).where("text <> ''").select("page_key", "block_no", F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(least)).alias("size"))


@query("split_to_fit")
def _(spark, d):
    return S.load(spark, d, "documents").select("doc_id", F.posexplode(F.flatten(F.transform(F.split("text", "\n", -1), lambda p: T.chunk_text(p, 384)))).alias("n", "piece")).where("piece <> ''")


# -- quality scan

HIGH_SQL = "native_char_count >= 300 and changed_blocks + unchanged_blocks > 0 and unchanged_blocks / (changed_blocks + unchanged_blocks) >= 0.85"
LEAK_SQL = "(select *, page in (select page from output_pages where regexp_matches(text, '(?i)ZXQ|Z[XQ]{0,4}(?:ENT|GLOS)\\w*\\d')) as leak from page_log)"
SCORE_SQL = f"""select page, high_unchanged, cast(case when leak then 100 else least(100, case when bad then 20 else 0 end + least(40, 10 * n_errors) + least(20, 5 * n_warnings) + case when high_unchanged then 10 else 0 end) end as bigint) as score,
  array_to_string(list_sort(list_filter([case when bad then 'status_not_ok' end, case when n_errors > 0 then 'page_errors' end, case when n_warnings > 0 then 'page_warnings' end, case when high_unchanged then 'high_unchanged_ratio' end, case when leak then 'zxq_leak' end], lambda x: x is not null)), ',') as reasons
  from (select *, {HIGH_SQL} as high_unchanged, status not in ('ok', 'ok_no_text') as bad from {LEAK_SQL})"""


def scored_pages(spark, d):
    return Q.page_scores(Q.with_leaks(S.page_log(spark, d), S.output_pages(spark, d)))


@query("qa_page_score", SCORE_SQL)
def _(spark, d):
    return scored_pages(spark, d).select("page", "high_unchanged", "score", F.array_join("reasons", ",").alias("reasons"))


@query("qa_top_risky", f"select * from ({SCORE_SQL}) order by score desc, page limit 10")
def _(spark, d):
    return Q.top_risky(scored_pages(spark, d))


@query("qa_summary", f"select count(*) as pages, count(*) filter (where status = 'ok') as ok_pages, count(*) filter (where n_errors > 0) as pages_with_errors, cast(sum(n_warnings) as bigint) as warnings, cast(sum(n_errors) as bigint) as errors, count(*) filter (where {HIGH_SQL}) as high_unchanged_pages, count(*) filter (where leak) as zxq_leak_pages, cast(sum(llm_candidates) as bigint) as llm_candidates, cast(sum(llm_changed) as bigint) as llm_changed, cast(sum(llm_rejected) as bigint) as llm_rejected, case when sum(llm_candidates) > 0 then round_even(sum(llm_rejected) / sum(llm_candidates), 4) else 0.0 end as llm_rejected_ratio from {LEAK_SQL}")
def _(spark, d):
    return Q.summary(scored_pages(spark, d))


@query("qa_issues", f"select 'high_unchanged_ratio' as issue, 'warning' as severity, page, round_even(unchanged_blocks / (changed_blocks + unchanged_blocks), 4) as ratio, cast(null as bigint) as n from page_log where {HIGH_SQL} union all select 'zxq_leak', 'error', null, null, count(*) from {LEAK_SQL} where leak having count(*) > 0")
def _(spark, d):
    return Q.issues(scored_pages(spark, d))


@query("qa_gate", f"select coalesce(max(score), 0) as max_score, coalesce(max(score), 0) >= 60 as score_failed, coalesce(bool_or(reasons like '%zxq_leak%'), false) as leak_failed from ({SCORE_SQL})")
def _(spark, d):
    return Q.gates(scored_pages(spark, d), 60, True)


@query("qa_text_report", f"select 'page ' || page || ': ' || score || ' (' || reasons || ')' as line from (select * from ({SCORE_SQL}) order by score desc, page limit 5)")
def _(spark, d):
    t = Q.top_risky(scored_pages(spark, d), 5)
    return t.select(F.concat(F.lit("page "), "page", F.lit(": "), "score", F.lit(" ("), "reasons", F.lit(")")).alias("line"))


@query("run_summary", "select count(*) filter (where status like 'ok%') as ok, count(*) filter (where status = 'fallback') as fallback, count(*) filter (where changed_blocks > 0) as translated, max(changed_blocks) > 0 as any_changed from page_log")
def _(spark, d):
    return S.page_log(spark, d).agg(F.count_if(F.col("status").startswith("ok")).alias("ok"), F.count_if(F.col("status") == "fallback").alias("fallback"), F.count_if(F.col("changed_blocks") > 0).alias("translated"), (F.max("changed_blocks") > 0).alias("any_changed"))


FAIL_SQL = """with a as (select *, row_number() over w as n, sum(cast(failed as int)) over w as total from attempts window w as (partition by run_id order by ts, event_id rows unbounded preceding)),
  b as (select *, case when failed then n - coalesce(max(case when not failed then n end) over (partition by run_id order by n rows unbounded preceding), 0) else 0 end as streak from a),
  c as (select *, failed and (streak >= 3 or total >= 10) as fatal from b),
  e as (select *, coalesce(max(cast(fatal as int)) over (partition by run_id order by n rows between unbounded preceding and 1 preceding), 0) as before from c)
  select run_id, event_id, cast(total as bigint) as total, cast(streak as int) as streak, fatal from e where before = 0"""


@query("failfast", FAIL_SQL)
def _(spark, d):
    return Q.failure_runs(S.attempts(spark, d))
