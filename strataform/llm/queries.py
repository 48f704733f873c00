"""The subpackage's queries, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.llm import ann, markup, mixing, packing, rankwalk, spam, splitting, tokens
from strataform.sources.tables import table

DOC_LIMIT, CHUNK_LIMIT, OVERLAP, BATCH_CHARS = 8000, 1200, 150, 4000


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = markup.clean_documents(table(spark, d, "eval_docs", "doc_id", "text"), F.col("doc_id"), F.col("text"))
    crumbs = markup.clean_breadcrumbs(table(spark, d, "chunks", "id", "breadcrumbs"), F.col("id"), F.col("breadcrumbs"))
    return docs.unionByName(crumbs)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_found(p1_clean(spark, d))


#: A heading or list line of plain words, as Markdown writes them; texts with code are left out, as it may hold such lines.
_MARKED_LINE = r"(?dm)^(#{2,6}|-) [\p{L}\p{N}]+(?: [\p{L}\p{N}]+)*$"
_CODE_SIGN = r"(?i)```|~~~|<[a-z!]|\\begin|[\$`]|\\\[|\\\("


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    """Every heading and list item that Markdown marks in plain words, and whether the clean text has it in its place as one."""
    texts = table(spark, d, "eval_docs", "text").where("text is not null").distinct().withColumn("id", F.md5("text"))
    clean = markup.clean_documents(texts, F.col("id"), F.col("text")).select("record_id", F.split("clean_text", "\n").alias("lines"))
    marked = texts.where(~F.col("text").rlike(_CODE_SIGN)).select("id", F.explode(F.regexp_extract_all("text", F.lit(_MARKED_LINE), F.lit(0))).alias("line")).distinct()
    shown = F.regexp_replace("line", "^-", "•")
    joined = marked.join(clean, F.col("id") == F.col("record_id"))
    return joined.select(F.col("id").alias("text_md5"), "line", F.array_contains("lines", shown).alias("kept"))


def p1_plain(spark: SparkSession, d: str) -> DataFrame:
    """Texts that come out without markup and without a sign that might be markup: nothing but white space may have changed."""
    docs = p1_clean(spark, d).where((F.col("record_kind") == "doc") & (F.size("markup") == 0) & ~F.col("clean_text").rlike(r"(?dm)[<>&\\$#*_`\[\]{}|=~+•◦▪‣·–]|''|--|^(?U)\s*[:;-]"))
    return docs.select("record_id", F.md5(F.regexp_replace("clean_text", r"(?U)[\s\x{FEFF}]+", "")).alias("letters")).distinct()


def _neighbours(spark: SparkSession, d: str, ids: DataFrame | None = None, **options) -> DataFrame:
    """Neighbours within each current space; the table of spaces is fixed and names one."""
    spaces = table(spark, d, "embedding_spaces", "model_id", "revision", "dims", "is_current").where("is_current").distinct().collect()
    rows = table(spark, d, "snapshot_vectors", "model_id", "revision", "chunk_id", "embedding")
    found = spark.createDataFrame([], "query_id string, chunk_id string, similarity double, place int")
    for n, space in enumerate(spaces):
        same = F.col("model_id").eqNullSafe(F.lit(space["model_id"])) & F.col("revision").eqNullSafe(F.lit(space["revision"]))
        near = ann.nearest(rows.where(same).select("chunk_id", "embedding"), space["dims"], ids, **options)
        found = near if n == 0 else found.unionByName(near)
    return found


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ann.pairs(_neighbours(spark, d, table(spark, d, "probe_vectors", "chunk_id")))


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall at ten of the search for all vectors, against brute force over the probes; one row."""
    ids = table(spark, d, "probe_vectors", "chunk_id")
    spaces = table(spark, d, "embedding_spaces", "model_id", "revision", "dims", "is_current").where("is_current")
    dims = spaces.agg(F.max("dims")).first()[0] or 0
    rows = table(spark, d, "snapshot_vectors", "model_id", "revision", "chunk_id", "embedding").join(F.broadcast(spaces), ["model_id", "revision"], "left_semi")  # fixed: one space is current
    near = _neighbours(spark, d).select("query_id", "chunk_id").withColumn("hit", F.lit(1))
    true = ann.exact(rows.select("chunk_id", "embedding"), dims, ids)
    shares = true.join(near, ["query_id", "chunk_id"], "left").agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))
    return shares.select("queries", F.coalesce(F.col("recall") >= 0.9, F.lit(True)).alias("enough"))


def p3_order(spark: SparkSession, d: str) -> DataFrame:
    return rankwalk.rank_walk(table(spark, d, "search_hits", "query_id", "list_id", "id", "score"), table(spark, d, "score_lists", "list_id", "better"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rankwalk.best(p3_order(spark, d), 5).select(F.col("query_id").cast("int").alias("query_id"), "id")


def p3_mass(spark: SparkSession, d: str) -> DataFrame:
    """Each usable chunk of a query once, their probabilities summing to one."""
    return p3_order(spark, d).groupBy(F.col("query_id").cast("int").alias("query_id")).agg(F.count("*").alias("items"), F.round(F.sum("mass"), 6).alias("mass"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    docs = splitting.split_oversized(table(spark, d, "eval_docs", "doc_id", "text"), F.col("doc_id"), F.col("text"), "doc", DOC_LIMIT, OVERLAP)
    chunks = splitting.split_oversized(table(spark, d, "chunks", "id", "text"), F.col("id"), F.col("text"), "chunk", CHUNK_LIMIT, OVERLAP)
    return docs.unionByName(chunks)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.cut_kinds(p4_pieces(spark, d))


def _joined(piece, part):
    """Parts of a group in order of their pieces; they are one text, which bounds them."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(piece, part.alias("part")))), lambda x: x["part"]), "")


def p4_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Texts put together again from their pieces, and whether every piece keeps its limits."""
    limit = F.when(F.col("record_kind") == "doc", DOC_LIMIT).otherwise(CHUNK_LIMIT)
    part = F.expr("substring(text, overlap + 1)")
    ok = F.max(F.length("text") - limit) <= 0
    rows = p4_pieces(spark, d).groupBy("record_kind", "record_id", "text_hash").agg(F.md5(_joined("piece", part)).alias("text_md5"), ok.alias("in_limit"), (F.max("overlap") <= OVERLAP).alias("in_overlap"))
    return rows.drop("text_hash")


def p6_batches(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "chunks", "text"), F.col("text"), BATCH_CHARS)


def p6_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct text once, put together from the batches, and whether it was cut."""
    return p6_batches(spark, d).groupBy("text_hash").agg(F.md5(_joined("piece", F.col("text"))).alias("text_md5"), (F.max("pieces") > 1).alias("cut")).drop("text_hash")


def p6_filled(spark: SparkSession, d: str) -> DataFrame:
    """One row: characters in all, batches over the capacity, and whether the batches are within one percent of the fewest."""
    sizes = p6_batches(spark, d).groupBy("batch_id").agg(F.sum("n_chars").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return sizes.agg(total.alias("n_chars"), F.count(F.when(F.col("n") > BATCH_CHARS, 1)).alias("over_capacity"), (F.count("*") <= 1.01 * F.ceil(total / BATCH_CHARS) + 1).alias("tight"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents", "doc_id", "text"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decode(p8_ids(spark, d))


def _mixed(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.mix(table(spark, d, "documents", "doc_id", "text", "source"), table(spark, d, "mix_targets", "source", "target_share", "max_repeats"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).drawn


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).shares


def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of each target: whether texts of it are drawn, within its repeats, and up to nine tenths of its share at least."""
    texts = F.col("texts") > 0
    return p9_shares(spark, d).select("source", texts.alias("has_texts"), (F.col("most_copies") <= F.col("max_repeats")).alias("capped"), (~texts | (F.col("reached_share") >= 0.9 * F.col("target_share"))).alias("reached"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return spam.judged(table(spark, d, "documents", "doc_id", "text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents", "doc_id", "text"))


_P4_SQL = """
with items as (
    select 'doc' as record_kind, doc_id as record_id, text, 8000 as lim from eval_docs
    union all select 'chunk', id, text, 1200 from chunks),
over_limit as (select * from items where length(text) > lim)
select record_kind, record_id,
    case when max(case when list_max(list_transform(regexp_split_to_array(text,
        '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0B.!?。！？]'),
        lambda x: length(x))) > lim then 1 else 0 end) = 1 then 'forced' else 'natural' end as cut
from over_limit group by record_kind, record_id
"""


_P2_SQL = """
with space as (select * from embedding_spaces where is_current),
raw as (select chunk_id, embedding::double[] as e from snapshot_vectors v join space s on v.model_id = s.model_id and v.revision = s.revision
    where len(v.embedding) = s.dims and chunk_id is not null),
good as (select distinct chunk_id, e from raw where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
near as (select q.chunk_id as a, x.chunk_id as b from good q, good x where q.chunk_id in (select chunk_id from probe_vectors) and q.chunk_id <> x.chunk_id
    qualify row_number() over (partition by q.chunk_id order by list_cosine_similarity(q.e, x.e) desc, x.chunk_id) <= 10)
select distinct least(a, b) as chunk_id_a, greatest(a, b) as chunk_id_b from near
"""
#: By another rule: the mean place over the query's lists, where a chunk missing from a list shares its bottom.  The five stand
#: clearly apart in these data, so that both rules must name them.
_P3_SQL = """
with best as (select query_id, h.list_id, id, min(case when better = 'low' then score else -score end) as key from search_hits h left join score_lists l using (list_id)
    where id is not null and score is not null and not isnan(score) group by query_id, h.list_id, id),
placed as (select *, rank() over w + (count(*) over (partition by query_id, list_id, key) - 1) / 2.0 as place from best window w as (partition by query_id, list_id order by key)),
items as (select query_id, count(distinct id) as n from best group by query_id),
lists as (select query_id, list_id, count(*) as k from best group by query_id, list_id),
grid as (select i.query_id, b.id, l.list_id, (l.k + 1 + i.n) / 2.0 as bottom from items i join (select distinct query_id, id from best) b using (query_id) join lists l using (query_id)),
means as (select query_id, id, avg(coalesce(place, bottom)) as m from grid left join placed using (query_id, list_id, id) group by query_id, id)
select query_id, id from means qualify row_number() over (partition by query_id order by m, id) <= 5
"""


_SPACES = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_P1_KEPT_SQL = r"""
with texts as (select distinct md5(text) as text_md5, text from eval_docs where text is not null and not regexp_matches(text, '(?i)```|~~~|<[a-z!]|\\begin|[$`]|\\\[|\\\('))
select distinct text_md5, unnest(regexp_extract_all(text, '(?m)^(#{2,6}|-) [\p{L}\p{N}]+(?: [\p{L}\p{N}]+)*$')) as line, true as kept from texts
"""
_P1_PLAIN_SQL = rf"""
with plain as (select doc_id, text from eval_docs where text is not null and not regexp_matches(text, '(?m)[<>&\\$#*_`\[\]{{}}|=~+•◦▪‣·–]|''''|--|^[{_SPACES}]*[:;-]')
    and not regexp_matches(text, '(?m)^[{_SPACES}]*[0-9]{{1,3}}[.)][{_SPACES}]'))
select distinct doc_id as record_id, md5(regexp_replace(text, '[{_SPACES}\x{{FEFF}}]+', '', 'g')) as letters from plain
"""
_P4_JOINED_SQL = """
select distinct 'doc' as record_kind, doc_id as record_id, md5(text) as text_md5, true as in_limit, true as in_overlap from eval_docs where length(text) > 8000
union all select distinct 'chunk', id, md5(text), true, true from chunks where length(text) > 1200
"""
_P6_TEXTS = f"with texts as (select distinct text from chunks where regexp_matches(text, '[^{_SPACES}]'))"


def queries() -> dict:
    names = (
        p1_found, p1_clean, p1_kept, p1_plain, p2_found, p2_neighbours, p2_recall, p3_found, p3_order, p3_mass, p4_found, p4_pieces, p4_rejoined, p6_batches, p6_rejoined, p6_filled,
        p8_ids, p8_decoded, p9_mix, p9_shares, p9_checked, p10_found, p10_shares,
    )
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_kept": _P1_KEPT_SQL,
        "p1_plain": _P1_PLAIN_SQL,
        "p2_found": _P2_SQL,
        "p2_recall": f"select count(distinct a) as queries, true as enough from ({_P2_SQL.replace('select distinct least(a, b) as chunk_id_a, greatest(a, b) as chunk_id_b from near', 'select a from near')})",
        "p3_mass": "select query_id, count(distinct id) as items, 1.0::double as mass from search_hits where id is not null and list_id is not null and query_id is not null and score is not null and not isnan(score) group by query_id",
        "p4_rejoined": _P4_JOINED_SQL,
        "p6_rejoined": _P6_TEXTS + " select md5(text) as text_md5, length(text) > 4000 as cut from texts",
        "p6_filled": _P6_TEXTS + " select cast(coalesce(sum(length(text)), 0) as bigint) as n_chars, 0::bigint as over_capacity, true as tight from texts",
        "p9_checked": f"select source, source in (select source from documents where source is not null and regexp_matches(text, '[^{_SPACES}]')) as has_texts, true as capped, true as reached from mix_targets where source is not null and target_share is not null",
        "p3_found": _P3_SQL,
        "p4_found": _P4_SQL,
        "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
    }
