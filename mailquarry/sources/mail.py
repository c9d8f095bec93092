"""Threads, cases, lists and results from files, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailquarry.functions import text as T
from mailquarry.functions import udf as U

MESSAGE = "message_id string, from_addr string, to_addrs array<string>, cc_addrs array<string>, bcc_addrs array<string>, subject string, date string, in_reply_to string, `references` array<string>, body string, word_count int, _source string"
THREAD = f"thread_id string, subject string, date_first string, date_last string, n_messages int, participants array<string>, messages array<struct<{', '.join(x.replace(' ', ':', 1) for x in MESSAGE.split(', '))}>>"
ANSWER_ROW = ("config", "topic_id", "found", "final")


def read_jsonl(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """One object a line; a broken line raises. A missing file may count as empty."""
    if missing_ok:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def display_name(address: Column) -> Column:
    """ada.reed@x becomes Ada Reed."""
    return F.initcap(F.replace(F.substring_index(address, "@", 1), F.lit("."), F.lit(" ")))


def load_messages(threads: DataFrame, users: DataFrame, least: int = 25) -> DataFrame:
    """Threads to clean messages of at least that many characters of subject and body; names from users (email,
    display_name), else from the address. Dates keep 19 characters."""
    m = threads.select("thread_id", F.posexplode("messages").alias("pos", "m")).select("thread_id", "pos", "m.*")
    m = m.withColumn("body", T.clean_body("body")).withColumn("index_text", F.trim(F.concat_ws(" ", F.coalesce("subject", F.lit("")), "body"))).where(F.length("index_text") >= least)
    named = users.select(F.lower("email").alias("_e"), F.col("display_name").alias("_n"))
    out = m.join(named, F.lower("from_addr") == F.col("_e"), "left").withColumn("from_name", F.coalesce("_n", display_name(F.col("from_addr")))).withColumn("date", F.substring("date", 1, 19))
    return out.drop("_e", "_n", "_source")


def load_cases(spark: SparkSession, paths: dict[str, str], schema: str, per_config: int = 0) -> DataFrame:
    """KEPT cases of each config's file, by topic_id; a quota takes half from W topics and the rest from C topics."""
    out = None
    for config, path in paths.items():
        df = read_jsonl(spark, path, schema).where("status = 'KEPT'").withColumn("config", F.lit(config))
        out = df if out is None else out.unionByName(df)
    if per_config <= 0:
        return out
    work = F.col("topic_id").startswith("W")
    n = F.row_number().over(Window.partitionBy("config", work).orderBy("topic_id"))
    return out.withColumn("_n", n).where(F.col("_n") <= F.when(work, per_config // 2).otherwise(per_config - per_config // 2)).drop("_n")


def clue_sets(spec: str) -> dict[str, str]:
    """Labels and paths of "file[:label],...": a file without a label has its name's stem."""
    out = {}
    for part in filter(str.strip, spec.split(",")):
        path, _, label = part.strip().partition(":")
        out[label or path.rstrip("/").rpartition("/")[2].rpartition(".")[0] or path] = path
    return out


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """One id a line, # starts a comment."""
    return spark.read.text(path).select(F.trim(F.split("value", "#")[0]).alias("message_id")).where("message_id <> ''").distinct()


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; blank means not judged."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def write_results(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.option("header", True).option("nullValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_maildir(spark: SparkSession, path: str) -> DataFrame:
    """(path, sender, body) of raw mail files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select("path", U.mail_body("content").alias("m")).select("path", "m.sender", "m.body")


def dataset(cases: DataFrame) -> DataFrame:
    """Cases as published: an id of config and topic, and the register that the topic's first letter tells."""
    register = F.when(F.col("topic_id").startswith("W"), "work").otherwise("casual")
    return cases.select(F.concat_ws("-", "config", "topic_id").alias("id"), "config", "topic_id", register.alias("register"), *[c for c in cases.columns if c not in ("config", "topic_id", "status")])


def with_address(people: DataFrame, known: DataFrame, name: str, domain: str) -> DataFrame:
    """people with an address: that of known (name, address), else the name in small letters with dots, unknown for none."""
    n = F.trim(F.coalesce(F.col(name), F.lit("")))
    made = F.concat(F.coalesce(F.nullif(F.lower(F.replace(n, F.lit(" "), F.lit("."))), F.lit("")), F.lit("unknown")), F.lit(f"@{domain}"))
    on_file = known.select(F.trim(name).alias("_n"), F.col("address").alias("_a"))
    return people.join(on_file, n == F.col("_n"), "left").withColumn("address", F.coalesce("_a", made)).drop("_n", "_a")


def load_topics(spark: SparkSession, path: str) -> DataFrame:
    """(id, plot, secret, either_or, era) of topics in a JSON document {"kept": [...]} or {"topics": [...]}, or one a line; of
    one id the last, in the order of files' names and of lines. The era keeps 10 characters. Lines are never read as one text: a first
    line that is an object of its own without such a list tells them."""
    fields = "id string, topic_id string, plot string, secret string, either_or string, era string"
    one = f"struct<{', '.join(x.replace(' ', ':', 1) for x in fields.split(', '))}>"
    head = spark.read.text(path).where("trim(value) <> ''").limit(1).select(F.try_parse_json("value").alias("v"))
    lined = F.schema_of_variant("v").startswith("OBJECT") & F.try_variant_get("v", "$.kept", "variant").isNull() & F.try_variant_get("v", "$.topics", "variant").isNull()
    if not head.where(lined).isEmpty():
        return _last_topics(_topic_lines(spark, path, fields))
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"kept array<{one}>, topics array<{one}>").alias("d"))
    listed = whole.select(F.posexplode(F.coalesce("d.kept", "d.topics")).alias("n", "t")).select("n", "t.*")
    lines = whole.where("d.kept is null and d.topics is null")
    if lines.isEmpty():
        rows = listed
    else:
        rows = _topic_lines(spark, path, fields)
    return _last_topics(rows)


def _topic_lines(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Topics one a line, with their place `n`: file, part of the file, line. A part is read in one run, so numbers rise in it."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    return spark.read.schema(fields).option("mode", "FAILFAST").json(path).select(place.alias("n"), "*")


def _last_topics(rows: DataFrame) -> DataFrame:
    named = rows.withColumn("id", F.coalesce("id", "topic_id")).where("id is not null")
    return named.groupBy("id").agg(F.max_by(F.struct("plot", "secret", "either_or", F.substring("era", 1, 10).alias("era")), "n").alias("t")).select("id", "t.*")


_PARTS = ["values", "details", "metadata", "store", "answer"]
_SAMPLE = f"sample string, epoch int, logged string, {', '.join(f'{p} string' for p in _PARTS)}, total_time double"


def _latest(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("sample", "epoch").agg(F.max_by(F.struct(*_PARTS, "total_time"), "logged").alias("r")).select("sample", "epoch", "r.*")
    return flat_rows(last, "sample", "epoch")


def rows_from_logs(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows of logs as JSON lines (sample, epoch, logged, values, details, metadata, store, answer, total_time; the four
    as JSON texts): the latest of each sample and epoch."""
    return _latest(spark.read.schema(_SAMPLE).json(path))


def rows_of_samples(content: DataFrame) -> DataFrame:
    """As rows_from_logs, of a table whose `content` is a sample as JSON, such as the members of zipped logs. A broken one raises."""
    one = F.from_json("content", _SAMPLE, {"mode": "FAILFAST"})
    return _latest(content.select(one.alias("s")).select("s.*"))


#: Columns of an evaluation row, in their fixed order, and the places that may have each, first to last; none for one that
#: controls fill. Names and order are those of the result files.
LADDER = {
    "config": ("metadata", "store"), "topic": ("metadata", "store"), "control": (), "rep": ("metadata",), "budget": ("metadata", "details", "store"),
    "found": ("values",), "secret_match": ("values",), "ev_recall": ("values",), "ev_precision": ("values",), "final": ("values",), "false_positive": (),
    "n_tool_calls": ("details",), "n_search": ("details",), "n_read": ("details",), "n_emails_opened": ("details",), "n_redundant_reads": ("details",),
    "n_clues_total": ("details", "metadata:n_clues"), "n_clues_read": ("details",), "clue_recall": ("values", "details"), "turns": ("details", "store"), "budget_hit": ("details",),
    "certified": (), "latency_s": (), "tester_chars": ("details", "store"), "secret": (),
}
#: What a column has where no place has it, if that is not blank.
WITHOUT = {"control": "0", "rep": "0"}


def flat_rows(samples: DataFrame, *keys: str, ladder: dict[str, tuple[str, ...]] = LADDER) -> DataFrame:
    """Samples, whose values, details, metadata and store are JSON texts, as flat rows of texts: a column is blank where no place
    has it. The secret is that of the details, else the answer, 400 characters of it. Whether the budget was hit is 1 or 0;
    total_time, a number of seconds, is rounded to three decimals."""
    at = lambda place, name: F.get_json_object(place.partition(":")[0], f"$.{place.partition(':')[2] or name}")
    columns = {name: F.coalesce(*[at(p, name) for p in places], F.lit(WITHOUT.get(name, ""))) for name, places in ladder.items()}
    hit = F.coalesce(at("store", "budget_hit"), F.lit("")).isin("true", "1")
    columns["budget_hit"] = F.coalesce(at("details", "budget_hit"), hit.cast("int").cast("string"))
    columns["latency_s"] = F.coalesce(F.round("total_time", 3).cast("string"), F.lit(""))
    columns["secret"] = F.substring(F.coalesce(at("details", "secret"), "answer", F.lit("")), 1, 400)
    return samples.select(*keys, *[c.alias(name) for name, c in columns.items()])


def metrics(df: DataFrame, column: str) -> DataFrame:
    """df with a row for each entry of a map<string,string> that is a number, as metric and amount."""
    rest = [c for c in df.columns if c != column]
    each = df.select(*rest, F.explode(column).alias("metric", "_v")).withColumn("amount", F.col("_v").try_cast("double"))
    return each.where(F.col("amount").isNotNull()).drop("_v")


def run_fault(total: str, completed: str, csv_rows: str, status: str, expected: Column) -> Column:
    """What is wrong with a run, empty if nothing."""
    short = (F.col(total) == 0) | (F.col(completed) != F.col(total))
    fault = F.when(expected.isNotNull() & (F.col(total) != expected), F.concat(F.lit("expected "), expected.cast("string"), F.lit(" samples"))).when(F.col(status) != "success", "status")
    return fault.when(short, "incomplete").when(F.col(csv_rows) != F.col(completed), "rows").otherwise("")
