"""One query for each operator of the log lake, over whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions import charclass, textstats
from .functions.regexlit import required_literals, tree_json
from .operators import search, substrings, templates, tokens
from .operators.ordered import carry_forward
from .plans import planner
from .session import cut, shared_folder, table
from .sources import lines as L
from .sources import store
from .streaming import tail

RG = 500
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BASE = f"""e as (select doc_id, unnest(string_split(text, chr(10))) log, generate_subscripts(string_split(text, chr(10)), 1) - 1 pos from documents),
l as (select *, row_number() over (order by doc_id, pos) - 1 line_no from e where log <> ''),
ll as (select *, line_no // {RG} rg from l)"""
TOKENS = BASE + """,
tk as (select rg, line_no, unnest(string_split_regex(log, '[: \\t]+')) token from ll),
m as (select *, (regexp_matches(token, '[0-9]'))::int + 2 * (regexp_matches(token, '[A-F]'))::int + 4 * (regexp_matches(token, '[a-f]'))::int
  + 8 * (regexp_matches(token, '[G-Z]'))::int + 16 * (regexp_matches(token, '[g-z]'))::int + 32 * (regexp_matches(token, '[^0-9A-Za-z]'))::int as type from tk where token <> ''),
ix as (select type, token, list_sort(list(distinct rg)) rgs from m group by 1, 2),
nr as (select max(rg) + 1 n from ll),
kept as (select * from ix where len(rgs) <= 0.5 * (select n from nr)),
card as (select type, count(*) n_tokens from kept group by 1)"""
LOGS = "lg as (select line_id, any_value(file_name) file_name, any_value(line_no) line_no, any_value(log_vector) log, line_id // 100 rg from log_lines where log_vector is not null group by line_id)"
MASKED = "array_to_string(list_transform(string_split(log, ' '), lambda w: case when regexp_matches(w, '[0-9]') then '<*>' else w end), ' ')"
TEMPLATES = LOGS + f""",
tg as (select *, {MASKED} masked from lg),
tm as (select masked template, count(*) n_lines from tg group by 1 having count(*) >= 2)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def doc_lines(spark: SparkSession, sf: str, key: str = "doc_id") -> DataFrame:
    return L.number_lines(table(spark, sf, "documents").dropDuplicates([key]), key, "text", RG)


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "log_lines").where("log_vector is not null").dropDuplicates(["line_id"])
    return rows.select("line_id", "file_name", "line_no", F.col("log_vector").alias("log"), F.expr("line_id div 100").alias("rg"))


def doc_index(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.inverted_index(doc_lines(spark, sf))


def row_groups_of(lines: DataFrame) -> int:
    return (lines.agg(F.max("rg")).first()[0] or 0) + 1


def planned(spark: SparkSession, sf: str) -> tuple[DataFrame, planner.Index]:
    lines = doc_lines(spark, sf)
    return lines, planner.Index.of(cut(tokens.inverted_index(lines)), row_groups_of(lines))


def joined(c: str = "row_groups"):
    return F.array_join(c, ",").alias("rgs")


# Ingest


@query(f"with {BASE} select doc_id, pos, log, line_no from ll")
def ingest_lines(spark, sf):
    return doc_lines(spark, sf).select("doc_id", "pos", "log", "line_no")


@query(f"with {BASE} select line_no, rg, rg // 10 file_id, rg % 10 local_group from ll")
def assign_row_groups(spark, sf):
    return doc_lines(spark, sf).select("line_no", "rg", F.expr("rg div 10").alias("file_id"), (F.col("rg") % 10).alias("local_group"))


@query(f"with {BASE} select rg, count(*) n_lines, sum(octet_length(encode(log)) + 1)::bigint n_bytes from ll group by 1")
def row_group_sizes(spark, sf):
    return doc_lines(spark, sf).groupBy("rg").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("log") + 1).alias("n_bytes"))


@query(f"with {BASE} select max(line_no) // {RG} + 1 n_row_groups, count(*) n_lines from ll")
def num_row_groups(spark, sf):
    return doc_lines(spark, sf).agg((F.expr(f"max(line_no) div {RG}") + 1).alias("n_row_groups"), F.count("*").alias("n_lines"))


def _unit_sql(name: str, source: str, size: str, order: str, limit: int, unit: str, by: str = "") -> str:
    """A recursive CTE ``name``: each row of ``source`` in order adds its size to the unit it is in; once that reaches the limit the next row begins a new one."""
    over, same = (f"partition by {by} order by {order}", f" and s.{by} = c.{by}") if by else (f"order by {order}", "")
    keep = f"{by}, " if by else ""
    return f"""{name}_k as (select *, row_number() over ({over}) k from {source}),
    {name}_c as (select {keep}k, 0::bigint {unit}, {size}::bigint held from {name}_k where k = 1
      union all select {"c." + keep if by else ""}s.k, case when c.held >= {limit} then c.{unit} + 1 else c.{unit} end, case when c.held >= {limit} then s.{size} else c.held + s.{size} end
      from {name}_c c join {name}_k s on s.k = c.k + 1{same}),
    {name} as (select * from {name}_k join {name}_c using ({keep}k))"""


SIZES = f"recursive {LOGS}, f as (select file_name, sum(octet_length(encode(log)) + 1)::bigint n_bytes from lg group by 1)"
GROUPS = f"{SIZES}, {_unit_sql('g', 'f', 'n_bytes', 'encode(file_name)', 32_768, 'group_id')}"
SPLITS = f"{GROUPS}, t as (select group_id, sum(n_bytes)::bigint n_bytes from g group by 1), {_unit_sql('sp', 't', 'n_bytes', 'group_id', 131_072, 'split')}"
LINE_SIZES = f"recursive {LOGS}, b as (select file_name, line_no, line_id, (octet_length(encode(log)) + 1)::bigint n from lg)"


@query(f"with {LINE_SIZES}, {_unit_sql('ch', 'b', 'n', 'line_no, line_id', 4096, 'chunk', 'file_name')} select line_id, chunk from ch")
def assign_chunks(spark, sf):
    sized = log_lines(spark, sf).select("file_name", "line_no", "line_id", (F.octet_length("log") + 1).cast("long").alias("n"))
    return L.assign_chunks(sized, ["file_name"], ["line_no", "line_id"], "n", 4096).select("line_id", F.col("chunk"))


def _listing(spark, sf):
    """File names and sizes in order, as a directory would list them."""
    per = log_lines(spark, sf).groupBy("file_name").agg(F.sum(F.octet_length("log") + 1).alias("n_bytes"))
    return [(r["file_name"], r["n_bytes"], 0) for r in per.orderBy("file_name").toLocalIterator()]


@query(f"with {GROUPS} select file_name, n_bytes, group_id from g")
def plan_groups(spark, sf):
    return spark.createDataFrame(L.cut_units([x[:2] for x in _listing(spark, sf)], 32_768), "file_name string, n_bytes long, group_id long")


@query(f"with {SPLITS} select file_name, group_id, split from g join (select group_id, split from sp) using (group_id)")
def plan_files(spark, sf):
    return spark.createDataFrame(store.plan_files(_listing(spark, sf), 32_768, 131_072), "file_name string, group_id long, split long")


@query(f"with {SPLITS} select group_id, n_bytes, split from sp")
def plan_splits(spark, sf):
    held: dict[int, int] = {}
    for _, n, g in L.cut_units([x[:2] for x in _listing(spark, sf)], 32_768):
        held[g] = held.get(g, 0) + n
    return spark.createDataFrame([(int(g), n, s) for g, n, s in L.cut_units([(str(g), n) for g, n in held.items()], 131_072)], "group_id long, n_bytes long, split long")


def _log_folder(spark, sf) -> str:
    """A folder of text files with the log lines, written once a session; their names hold blanks and percent signs."""
    folder = shared_folder(spark, f"logs-{abs(hash(sf))}")
    if store.exists(spark, f"{folder}/_done"):
        return folder
    store.remove(spark, folder)
    store.remove(spark, f"{folder}-parts")
    rows = log_lines(spark, sf).select(F.regexp_replace("file_name", "[^A-Za-z0-9.-]", " %").alias("name"), "line_no", "line_id", "log")
    placed = rows.repartition("name").sortWithinPartitions("name", "line_no", "line_id").select("name", F.col("log").alias("value"))
    placed.write.partitionBy("name").text(f"{folder}-parts")
    fs, parts = store._fs(spark, f"{folder}-parts")
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(path_of(folder))
    for k, one in enumerate(sorted((s.getPath() for s in fs.listStatus(parts) if s.isDirectory()), key=lambda p: p.getName())):
        name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(one.getName()[5:])
        (file,) = [s.getPath() for s in fs.listStatus(one) if s.getPath().getName().startswith("part-")]
        fs.rename(file, path_of(folder, name))
        fs.setTimes(path_of(folder, name), 1_700_000_000_000 + 1000 * k, -1)
    store.remove(spark, f"{folder}-parts")
    store.write_marker(spark, f"{folder}/_done", {})
    return folder


NAMED = LOGS + """, nm as (select line_id, regexp_replace(file_name, '[^A-Za-z0-9.-]', ' %', 'g') file, line_no p, log from lg),
    pieces as (select file, p, line_id, unnest(string_split(log, chr(10))) log, generate_subscripts(string_split(log, chr(10)), 1) i from nm),
    fl as (select * from pieces where log <> '')"""


@query(f"with {NAMED} select file, log, row_number() over (order by encode(file), p, line_id, i) - 1 line_no, (row_number() over (order by encode(file), p, line_id, i) - 1) // 100 rg from fl")
def ingest_files(spark, sf):
    """Index a folder of files, in one split, and read the lines back."""
    index = shared_folder(spark, "ingest-files")
    store.remove(spark, index)
    files = store.list_files(spark, _log_folder(spark, sf))
    planned = [(p, 0, 0) for p, *_ in files]
    store.write_split(store.ingest_group(spark, planned, row_group=100), index, 100, splits=[0])
    return store.committed(spark, index, "lines").select("file", "log", "line_no", "rg")


@query(f"with {NAMED}, ex as (select *, epoch(try_strptime(substr(log, 1, 19), '%Y-%m-%d %H:%M:%S'))::bigint s from fl), ep as (select *, case when s >= 946684800 and s < 2524608000 then s end e from ex) select file, log, coalesce(last_value(e ignore nulls) over (partition by file order by p, line_id, i rows unbounded preceding), 0) epoch, row_number() over (order by encode(file), p, line_id, i) - 1 line_no from ep")
def ingest_epochs(spark, sf):
    """The same with the time of each line, or of the last valid one before it in its file."""
    files = store.list_files(spark, _log_folder(spark, sf))
    return store.ingest_group(spark, [(p, 0, 0) for p, *_ in files], 19, "yyyy-MM-dd HH:mm:ss", 100).select("file", "log", "epoch", "line_no")


@query(f"with {NAMED} select file, log, count(*) n from fl where file <> (select file from fl order by encode(file) desc limit 1) group by 1, 2")
def tail_index(spark, sf):
    """Tail mode over a copy of the folder: all files but the one written last are moved, indexed in several splits, and the splits merged."""
    base = shared_folder(spark, "tail")
    store.remove(spark, base)
    fs, source = store._fs(spark, _log_folder(spark, sf))
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(path_of(f"{base}/in"))
    for path, _, modified in store.list_files(spark, _log_folder(spark, sf)):
        target = path_of(f"{base}/in", store.name_of(path))
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path_of(path), fs, target, False, spark._jsc.hadoopConfiguration())
        fs.setTimes(target, modified, -1)
    tail.settle(spark, f"{base}/in", f"{base}/inbox")
    tail.start_tail(spark, f"{base}/inbox", f"{base}/ix", 1, row_group=100, once=True, compaction_bytes=1).awaitTermination()
    return store.committed(spark, f"{base}/ix", "lines").groupBy("file", "log").agg(F.count("*").alias("n"))


@query(f"with {BASE} select rg // 32 split, count(*) n_lines, count(distinct rg) n_row_groups from ll group by 1")
def list_splits(spark, sf):
    """The committed splits of a stored index, as its commits tell."""
    rows = [(n, c["lines"], c["row_groups"]) for n, c in store.commits(spark, stored(spark, sf)).items()]
    return spark.createDataFrame(rows, "split long, n_lines long, n_row_groups long")


@query(f"with {BASE} select doc_id::varchar file, line_no, rg, log from ll")
def compact_index(spark, sf):
    """Merge all splits of a stored index into one and read it back: row groups are numbered on, nothing is lost."""
    into = shared_folder(spark, "compacted")
    store.remove(spark, into)
    store.compact_splits(spark, stored(spark, sf), store.splits_of(spark, stored(spark, sf)), into, 0, RG)
    return store.committed(spark, into, "lines").select("file", "line_no", "rg", "log")


@query()
def sample_lines(spark, sf):
    """The 1,000 lines with the least hash: the same in every run, without bias."""
    return log_lines(spark, sf).orderBy(F.xxhash64("line_id"), "line_id").limit(1000)


# Time


EPOCHS = LOGS + ", ep as (select *, epoch(try_strptime(substr(log, 1, 19), '%Y-%m-%d %H:%M:%S'))::bigint s from lg), ex as (select line_id, file_name, line_no, case when s >= 946684800 and s < 2524608000 then s end epoch from ep)"


def _epochs(spark, sf):
    return log_lines(spark, sf).withColumn("epoch", L.extract_epoch(F.col("log"), 19, "yyyy-MM-dd HH:mm:ss")).select("line_id", "file_name", "line_no", "epoch")


@query(f"with {EPOCHS} select line_id, epoch from ex")
def ts_extract(spark, sf):
    return _epochs(spark, sf).select("line_id", "epoch")


@query(f"with {EPOCHS} select line_id, coalesce(last_value(epoch ignore nulls) over (partition by file_name order by line_no rows unbounded preceding), 0) epoch from ex")
def ts_backfill(spark, sf):
    return L.backfill(_epochs(spark, sf), "file_name", "line_no", "epoch").select("line_id", "epoch")


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as formatted, epoch_us(ts) // 1000000 as epoch_s from events")
def ts_format(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("formatted"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch_s"))


# Character classes and tokens


@query(f"with {TOKENS} select token, any_value(type) as type from m group by 1")
def type_mask(spark, sf):
    found = doc_lines(spark, sf).select(F.explode(tokens.tokenize(F.col("log"))).alias("token")).distinct()
    return found.withColumn("type", charclass.type_mask(F.col("token")))


@query("select q.range mask, t.range as type from range(1, 64) q, range(1, 64) t where t.range & q.range = q.range")
def type_supersets(spark, sf):
    return spark.createDataFrame([(q, t) for q in range(1, 64) for t in charclass.supersets(q)], "mask long, type long")


@query(f"with {TOKENS} select line_no, count(*) n_tokens, string_agg(token, '|' order by token) found from tk where token <> '' group by 1")
def tokenize(spark, sf):
    found = doc_lines(spark, sf).withColumn("t", tokens.tokenize(F.col("log"))).where(F.size("t") > 0)
    return found.select("line_no", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.array_sort("t"), "|").alias("found"))


@query(f"with {TOKENS}, sg as (select type, token, rg // {tokens.SEGMENT} segment, list_sort(list(distinct rg)) rgs from m group by 1, 2, 3) select type, token, segment, array_to_string(rgs, ',') rgs from sg")
def inverted_index(spark, sf):
    return doc_index(spark, sf).select("type", "token", "segment", joined())


@query(f"with {TOKENS} select type, count(*) n_tokens from ix group by 1")
def type_cardinality(spark, sf):
    return tokens.type_cardinality(doc_index(spark, sf))


@query(f"with {TOKENS} select type, token, array_to_string(rgs, ',') rgs from kept join card using (type) where n_tokens <= 1000")
def outlier_tokens(spark, sf):
    return planned(spark, sf)[1].outliers.select("type", "token", joined())


@query(f"with {TOKENS} select type, token, (row_number() over (partition by type order by encode(token)) - 1) // 100 token_block from ix")
def token_blocks(spark, sf):
    return tokens.token_blocks(doc_index(spark, sf), 100).select("type", "token", "token_block")


# Compaction


PARTS = "p as (select distinct token_type as type, token, unnest(inverted_index) rg from postings where token is not null)"


@query(f"with {PARTS} select type, token, array_to_string(list_sort(list(distinct rg) filter (rg is not null)), ',') rgs from p where rg is not null group by 1, 2")
def compact_postings(spark, sf):
    parts = table(spark, sf, "postings").where("token is not null").select(F.col("token_type").alias("type"), "token", F.col("inverted_index").alias("row_groups"))
    return tokens.compact_postings(parts).where(F.size("row_groups") > 0).select("type", "token", joined())


@query(f"with {TOKENS} select type, token from ix where len(rgs) > 0.5 * (select n from nr)")
def dictionary_tokens(spark, sf):
    return planned(spark, sf)[1].dictionary.select("type", "token")


@query("select token, group_id, posting_id, row_number() over (order by encode(token) nulls first, group_id nulls first, posting_id nulls first) - 1 as rank from postings")
def merge_sorted(spark, sf):
    rows = table(spark, sf, "postings").select("token", "group_id", "posting_id")
    even = F.coalesce(F.col("group_id") % 2, F.lit(0)) == 0
    return tokens.merge_sorted([rows.where(even), rows.where(~even)], ["token", "group_id", "posting_id"])


@query(f"with {TOKENS}, s as (select type, token, len(rgs) n, sum(len(rgs)) over (partition by type order by encode(token)) upto from ix) select type, token, (upto - n)::bigint as begin, upto::bigint as \"end\" from s")
def csr_offsets(spark, sf):
    return tokens.csr_offsets(doc_index(spark, sf))


@query(f"""with {TOKENS} select type, count(*) n_tokens, sum(len(rgs))::bigint n_postings, max(len(rgs)) longest, count(*) filter (len(rgs) = 1) n_single,
    sum(octet_length(encode(token)))::bigint token_bytes from ix group by 1""")
def posting_stats(spark, sf):
    return tokens.posting_stats(doc_index(spark, sf))


# Templates and variables


def _assigned(spark, sf):
    found = log_lines(spark, sf)
    return templates.assign_templates(found, "log", templates.mine_templates(found, "log", 2))


@query(f"with {TEMPLATES} select template, n_lines from tm")
def mine_templates(spark, sf):
    return templates.mine_templates(log_lines(spark, sf), "log", 2).select("template", "n_lines")


@query(f"with {TEMPLATES} select line_id, template from tg left join tm on masked = template")
def assign_templates(spark, sf):
    return _assigned(spark, sf).select("line_id", "template")


VARS = (
    LOGS
    + """, ws as (select line_id, rg, list_filter(string_split(log, ' '), lambda w: regexp_matches(w, '[0-9]')) v from lg),
    va as (select line_id, rg, unnest(v) as value, generate_subscripts(v, 1) - 1 as var from ws where len(v) > 0),
    vt as (select *, (regexp_matches(value, '[0-9]'))::int + 2 * (regexp_matches(value, '[A-F]'))::int + 4 * (regexp_matches(value, '[a-f]'))::int
      + 8 * (regexp_matches(value, '[G-Z]'))::int + 16 * (regexp_matches(value, '[g-z]'))::int + 32 * (regexp_matches(value, '[^0-9A-Za-z]'))::int as type from va)"""
)


@query(f"with {VARS} select line_id, var, value, type from vt")
def extract_variables(spark, sf):
    return templates.extract_variables(log_lines(spark, sf), "log", ["line_id"])


@query(f"with {VARS} select type, value as token, array_to_string(list_sort(list(distinct rg)), ',') rgs from vt group by 1, 2")
def variable_index(spark, sf):
    found = templates.extract_variables(log_lines(spark, sf), "log", ["line_id", "rg"])
    return templates.variable_index(found).select("type", "token", joined())


TP = TEMPLATES + ", ta as (select line_id, rg, template from tg left join tm on masked = template)"


@query(f"with {TP} select template, array_to_string(list_sort(list(distinct rg)), ',') rgs from ta where template is not null group by 1")
def template_postings(spark, sf):
    return templates.template_postings(_assigned(spark, sf)).select("template", joined())


@query(f"with {TP} select distinct template from ta where template is not null")
def live_templates(spark, sf):
    return templates.template_postings(_assigned(spark, sf)).select("template")


@query(f"with {TP} select line_id, rg from ta where template is null")
def outlier_lines(spark, sf):
    return templates.outlier_lines(_assigned(spark, sf)).select("line_id", "rg")


# Search


LITERAL, REGEX, PHRASE, RARE = "rebuild of index", "heartbeat from m(30|28) (missed|received)", "segment 5 for shard", "load_kw_9"


def stored(spark, sf) -> str:
    """A stored index of the document lines in splits of 32 row groups, built once a session in the folder for checkpoints."""
    path = shared_folder(spark, f"index-{abs(hash(sf))}")
    if not store.splits_of(spark, path):
        lines = doc_lines(spark, sf).select(F.expr("cast(rg div 32 as int)").alias("split"), F.col("doc_id").cast("string").alias("file"), "line_no", "rg", F.lit(None).cast("long").alias("epoch"), "log")
        store.write_split(lines, path, RG)
    return path


def _found(spark, sf, text: str, mode: str = "literal") -> DataFrame:
    return search.search_index(spark, stored(spark, sf), text, mode).select(F.col("file").cast("long").alias("doc_id"), "line_no", "log", "split")


@query(f"with {BASE} select doc_id, line_no, log from ll where contains(log, '{LITERAL}')")
def search_bruteforce(spark, sf):
    return search.bruteforce(store.committed(spark, stored(spark, sf), "lines"), LITERAL).select(F.col("file").cast("long").alias("doc_id"), "line_no", "log")


@query(ORACLES["search_bruteforce"])
def search_pruned(spark, sf):
    return _found(spark, sf, LITERAL).drop("split")


@query(f"with {BASE} select doc_id, line_no, log from ll where contains(log, '{RARE}')")
def search_literal(spark, sf):
    return _found(spark, sf, RARE).drop("split")


@query(f"with {BASE} select doc_id, line_no, log from ll where regexp_matches(log, '{REGEX}')")
def search_regex(spark, sf):
    return _found(spark, sf, REGEX, "regex").drop("split")


@query(f"with {BASE} select doc_id, line_no, log from ll where contains(log, '{PHRASE}')")
def search_phrase(spark, sf):
    return _found(spark, sf, PHRASE).drop("split")


@query(f"with {BASE} select doc_id, line_no, log from ll where contains(log, '{LITERAL}') order by line_no desc limit 25")
def search_topk(spark, sf):
    return search.topk(_found(spark, sf, LITERAL), [F.desc("line_no")], 25).drop("split")


@query(f"with {BASE} select doc_id, line_no, log from (select *, rg // 32 split from ll where contains(log, '{LITERAL}')) order by split desc, line_no limit 30")
def search_limit(spark, sf):
    """The public search: newest split first, whatever number of splits it has to read."""
    return api.search(spark, stored(spark, sf), LITERAL, 30).select(F.col("file").cast("long").alias("doc_id"), "line_no", "log")


@query(f"""with {BASE}, h as (select *, rg // 32 split from ll where contains(log, '{LITERAL}')),
    c as (select split, coalesce(sum(count(*)) over (order by split desc rows between unbounded preceding and 1 preceding), 0) prior from h group by split)
    select doc_id, line_no, split from h where split in (select split from c where prior <= 40)""")
def search_soft_limit(spark, sf):
    return search.soft_limit(_found(spark, sf, LITERAL), "split", 40).select("doc_id", "line_no", F.col("split").cast("long").alias("split"))


@query(f"with {BASE} select distinct log from ll where contains(log, '{LITERAL}')")
def search_distinct(spark, sf):
    return search.distinct_lines(_found(spark, sf, LITERAL))


CODES = ("window", "zzzz", "Epoch", "load_kw_9", "e", "Traceback", "91")


@query(f"""with {TOKENS}, q as (select unnest([{", ".join(repr(c) for c in CODES)}]) q),
    d as (select token from ix where len(rgs) > 0.5 * (select n from nr)), o as (select token, rgs from kept join card using (type) where n_tokens <= 1000)
    select q as query, case when exists (select 1 from d where contains(token, q)) then 0
      when (select count(distinct r) from (select unnest(rgs) r from o where contains(token, q))) >= 10 then 1 else 2 end::bigint code from q""")
def search_plan_code(spark, sf):
    return planner.plan_code(planned(spark, sf)[1], spark.createDataFrame([(c,) for c in CODES], "query string"), 10)


@query(f"with {TOKENS} select type, token, array_to_string(rgs, ',') rgs from kept where contains(token, 'kw_9')")
def postings_lookup(spark, sf):
    return planner.lookup(planned(spark, sf)[1].lists(), [planner.Piece("kw_9", True, True)]).select("type", "token", joined())


TWO = "opened segment"


@query(f"""with {TOKENS}, w as (select 0 piece, token, rgs, len(rgs) > 0.5 * (select n from nr) common from ix where ends_with(token, 'opened')
      union all select 1, token, rgs, len(rgs) > 0.5 * (select n from nr) from ix where starts_with(token, 'segment')),
    u as (select piece from (select unnest([0, 1]) piece) where piece not in (select piece from w where common)), h as (select distinct piece, unnest(rgs) rg from w where piece in (select piece from u))
    select rg from h group by 1 having count(*) = (select count(*) from u)
    union all select distinct rg from ll where not exists (select 1 from u)""")
def candidate_row_groups(spark, sf):
    found = planner.candidate_row_groups(planned(spark, sf)[1], [TWO])
    return found if found is not None else doc_lines(spark, sf).select("rg").distinct()


GRAMS = TOKENS + f""",
ur as (select distinct rg // 32 split, rg, chr(10) || token || chr(10) t from m),
gr as (select split, rg, substr(t, i, {tokens.GRAM}) gram from (select split, rg, t, unnest(range(1, length(t) - {tokens.LEAST} + 2)) i from ur)),
sn as (select rg // 32 split, count(distinct rg) n from ll group by 1),
gx as (select split, gram, list_sort(list(distinct rg)) rgs from gr group by 1, 2)"""


@query(f"with {GRAMS} select split, gram, case when len(rgs) <= 0.5 * n then array_to_string(rgs, ',') end rgs from gx join sn using (split)")
def gram_postings(spark, sf):
    """The substring index as stored: grams of framed tokens and their row groups, none for grams in most row groups of their split."""
    grams = store.committed(spark, stored(spark, sf), "grams")
    return grams.select(F.col("split").cast("long").alias("split"), "gram", joined())


@query(f"with {TOKENS} select type, token from ix where starts_with(token, 'load_')")
def token_prefix(spark, sf):
    return doc_index(spark, sf).where(planner.Piece("load_", False, True).matches(F.col("token"))).select("type", "token")


@query(f"with {TOKENS} select type, token from ix where ends_with(token, '.csv'')')")
def token_suffix(spark, sf):
    return doc_index(spark, sf).where(planner.Piece(".csv')", True, False).matches(F.col("token"))).select("type", "token")


@query(f"with {TOKENS} select type, token, array_to_string(rgs, ',') rgs from ix where token = 'signal'")
def token_exact(spark, sf):
    return doc_index(spark, sf).where(planner.Piece("signal", False, False).matches(F.col("token"))).select("type", "token", joined())


@query(f"with {BASE} select log from ll where contains(log, '{LITERAL}') union all select log from ll where contains(log, '{RARE}')")
def union_results(spark, sf):
    return _found(spark, sf, LITERAL).select("log").unionByName(_found(spark, sf, RARE).select("log"))


def _pruning_sql() -> str:
    keys = planner.gram_keys([RARE])
    rows = ", ".join(f"('{k}')" for k in keys)
    return f"""with {GRAMS}, k as (select key from (values {rows}) t(key)),
    hit as (select split, key, rgs, len(rgs) > 0.5 * n common from gx join sn using (split) join k on case when length(key) < {tokens.GRAM} then starts_with(gram, key) else gram = key end),
    cm as (select split, count(distinct key) nc from hit where common group by 1),
    ps as (select distinct split, key, unnest(rgs) rg from hit h where not exists (select 1 from hit c where c.split = h.split and c.key = h.key and c.common)),
    ok as (select split, rg from ps group by 1, 2 having count(*) = {len(keys)} - coalesce((select nc from cm where cm.split = ps.split), 0)),
    needed as (select split, count(distinct rg) n_needed from (select rg // 32 split, rg from ll where contains(log, '{RARE}')) group by 1)
    select sn.split, sn.n n_row_groups, case when coalesce(nc, 0) = {len(keys)} then sn.n else coalesce((select count(*) from ok where ok.split = sn.split), 0) end n_candidates, coalesce(n_needed, 0) n_needed, true as is_sound
    from sn left join cm using (split) left join needed using (split)"""


@query(_pruning_sql())
def pruning_stats(spark, sf):
    """For each split: its row groups, those the index leaves for a rare word, those that hold it, and whether every one of these is left."""
    path = stored(spark, sf)
    left = search.prune(spark, path, store.commits(spark, path), RARE)
    rows = [(p.split, p.row_groups, p.n_kept, p.kept) for p in left]
    per = spark.createDataFrame(rows, "split int, n_row_groups long, n_candidates long, kept array<long>")
    hits = search.bruteforce(store.committed(spark, path, "lines"), RARE).groupBy("split").agg(F.collect_set("rg").alias("needed"))
    both = per.join(hits, "split", "left")
    needed = F.coalesce("needed", F.array().cast("array<bigint>"))
    sound = F.col("kept").isNull() | (F.size(F.array_except(needed, "kept")) == 0)
    return both.select(F.col("split").cast("long").alias("split"), "n_row_groups", "n_candidates", F.size(needed).cast("long").alias("n_needed"), sound.alias("is_sound"))


# Substring structures


SUFFIX = "sx as (select item_id, i - 1 start, substr(question, i) s, case when i > 1 then substr(question, i - 1, 1) else '' end as ch from (select item_id, question, unnest(range(1, length(question) + 1)) i from eval_items)), sr as (select *, row_number() over (partition by item_id order by encode(s)) - 1 as rank from sx)"
CHARS = "ch as (select item_id, i - 1 pos, substr(question, i, 1) ch from (select item_id, question, unnest(range(1, length(question) + 1)) i from eval_items))"


@query(f"with {SUFFIX} select item_id, rank, start from sr")
def suffix_array(spark, sf):
    return substrings.suffix_array(table(spark, sf, "eval_items"), "item_id", "question").select("item_id", "rank", "start")


@query(f"with {SUFFIX} select item_id, rank, ch from sr")
def bwt_chars(spark, sf):
    return substrings.bwt_chars(table(spark, sf, "eval_items"), "item_id", "question")


@query(f"with {CHARS}, n as (select item_id, ch, count(*) n from ch group by 1, 2) select item_id, ch, coalesce(sum(n) over (partition by item_id order by encode(ch) rows between unbounded preceding and 1 preceding), 0)::bigint n_less from n")
def c_array(spark, sf):
    return substrings.c_array(table(spark, sf, "eval_items"), "item_id", "question")


@query(f"with {CHARS} select item_id, pos, ch, row_number() over (partition by item_id, ch order by pos) - 1 as rank from ch")
def char_rank(spark, sf):
    return substrings.char_rank(table(spark, sf, "eval_items"), "item_id", "question")


@query("select doc_id, len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 2) = 'ss'))::bigint n from documents where text is not null")
def fm_count(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", substrings.fm_count(F.col("text"), "ss").cast("long").alias("n"))


@query(f"with {TOKENS}, b as (select type, token, (row_number() over (partition by type order by encode(token)) - 1) // 100 token_block from ix) select distinct type, token_block from b where contains(token, 'kw_')")
def fm_locate_blocks(spark, sf):
    blocks = tokens.token_blocks(doc_index(spark, sf), 100)
    return blocks.where(F.col("token").contains("kw_")).select("type", "token_block").distinct()


# Text statistics


@query("""with h as (select hex(encode(text)) x from documents where text is not null), b as (select substr(x, 2 * i + 1, 2) as byte from (select x, unnest(range(0, length(x) // 2)) i from h)),
    c as (select byte, count(*) n from b group by 1), t as (select sum(n) t from c) select round(-sum(n / t * log2(n / t)), 6) entropy from c, t""")
def byte_entropy(spark, sf):
    return textstats.byte_entropy(table(spark, sf, "documents"), "text")


@query("select doc_id, not regexp_matches(text, '[^\\x00-\\x7F]') ascii_only from documents where text is not null")
def is_ascii(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", textstats.is_ascii(F.col("text")).alias("ascii_only"))


@query(f"with {LOGS} select line_id, log from lg where not starts_with(log, '20')")
def prefix_check(spark, sf):
    return log_lines(spark, sf).where(~F.col("log").startswith("20")).select("line_id", "log")


@query("""with d as (select distinct line_id, file_name, line_no, epoch_ts from log_lines where epoch_ts is not null)
    select file_name, max(abs(epoch_ts - prior)) max_delta, count(*) n from (select file_name, epoch_ts, lag(epoch_ts, 1, 0) over (partition by file_name order by line_no) prior from d) group by 1""")
def max_delta(spark, sf):
    rows = table(spark, sf, "log_lines").where("epoch_ts is not null").dropDuplicates(["line_id"]).select("file_name", "line_no", "epoch_ts")
    prior = carry_forward(rows, ["file_name"], ["line_no"], "epoch_ts", "prior", strict=True)
    return prior.groupBy("file_name").agg(F.max(F.abs(F.col("epoch_ts") - F.coalesce("prior", F.lit(0)))).alias("max_delta"), F.count("*").alias("n"))


@query()
def roaring_postings(spark, sf):
    """Bitmaps of the row groups of each token type: bucket, bits set."""
    rgs = doc_index(spark, sf).select("type", F.explode("row_groups").alias("rg")).distinct()
    maps = rgs.groupBy("type", F.bitmap_bucket_number("rg").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("rg")).alias("bits"))
    return maps.select("type", "bucket", F.bitmap_count("bits").alias("n_row_groups"))


ORACLES["roaring_postings"] = f"with {TOKENS} select type, case when rg > 0 then 1 + (rg - 1) // 32768 else 0 end bucket, count(distinct rg) n_row_groups from m group by 1, 2"


# On the driver


@query()
def regex_literals(spark, sf):
    patterns = ["abc", "a*bc", "x(yz)w", "(a|b)cd", "a.b", "fo*bar", "(ab)*"]
    return spark.createDataFrame([(p, "|".join(required_literals(p))) for p in patterns], "pattern string, literals string")


TREES = ("a*b*c", "(a|b)c", "ab*")


@query()
def regex_tree(spark, sf):
    return spark.createDataFrame([(p, tree_json(p)) for p in TREES], "pattern string, tree string")


ORACLES["regex_literals"] = """select * from (values ('abc', 'abc'), ('a*bc', 'bc'), ('x(yz)w', 'xyzw'), ('(a|b)cd', 'cd'), ('a.b', ''), ('fo*bar', 'f|bar'), ('(ab)*', '')) t(pattern, literals)"""
ORACLES["regex_tree"] = """select * from (values
    ('a*b*c', '{"kind": "concat", "children": [{"kind": "star", "children": [{"kind": "char", "text": "a"}]}, {"kind": "star", "children": [{"kind": "char", "text": "b"}]}, {"kind": "char", "text": "c"}]}'),
    ('(a|b)c', '{"kind": "concat", "children": [{"kind": "union", "children": [{"kind": "char", "text": "a"}, {"kind": "char", "text": "b"}]}, {"kind": "char", "text": "c"}]}'),
    ('ab*', '{"kind": "concat", "children": [{"kind": "char", "text": "a"}, {"kind": "star", "children": [{"kind": "char", "text": "b"}]}]}')) t(pattern, tree)"""
