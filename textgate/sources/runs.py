"""Recorded runs: many report files by name pattern, broken ones set aside, and their rows as outcomes, pairs and a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textgate.functions import patterns as P
from textgate.operators import reports

ROW = (
    "struct<id:string,issueClass:string,source:string,expectedAction:string,action:string,replacement:string,reason:string,surfaced:boolean,rejection:string,modelRejection:string,"
    "rejectedText:string,lostWords:array<string>,verifierReason:string,milliseconds:double,stages:struct<mechanics:boolean,rule:boolean,grammar:boolean,model:boolean>>"
)
REPORT = f"corpusName string, corpusSHA256 string, promptSHA256 string, generatedAtUTC string, model struct<id:string>, rows array<{ROW}>"
#: The stage that is named where several took part.
STAGES = ("mechanics", "rule", "grammar", "model")


def report_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """``run``, ``file``, ``sha256``, ``bytes``, the parsed ``report`` and ``error`` of every file below a folder whose name fits the pattern.

    A file is read whole, with its digest, by one task; files that are no report have an ``error`` and no ``report``.  It is an error if no file fits.  Spark skips files without a byte.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    if found.select("path").isEmpty():
        raise FileNotFoundError(f"no file named {pattern} below {path}")
    text = F.decode("content", "UTF-8")
    body = F.from_json(text, REPORT, {"mode": "PERMISSIVE"})
    sound = F.try_parse_json(text).isNotNull() & F.json_object_keys(text).isNotNull()
    told = found.select(F.regexp_extract("path", "([^/]*?)(?:\\.[^./]*)?$", 1).alias("run"), F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), body.alias("report"), F.coalesce(sound, F.lit(False)).alias("__sound"))
    error = F.when(~F.col("__sound"), "no JSON object").when(F.col("report.rows").isNull(), "no rows")
    return told.withColumn("error", error).withColumn("report", F.when(error.isNull(), F.col("report"))).drop("__sound")


def set_aside(files: DataFrame) -> DataFrame:
    """The broken files, with why: the quarantine beside ``report_rows``."""
    return files.where("error is not null").select("run", "file", "sha256", "bytes", "error")


def report_rows(files: DataFrame) -> DataFrame:
    """The rows of all sound files, each with its run, file and digest."""
    return files.where("error is null").select("run", "file", "sha256", "bytes", F.explode("report.rows").alias("row")).select("run", "file", "sha256", "bytes", "row.*")


def outcomes(rows: DataFrame) -> DataFrame:
    """Rows as what came of each: surfaced, refused or quiet, with what was proposed, what was shown, and by which stage.

    The model's own refusal goes before that of the sentence; fields that older runs lack are null.
    """
    refusal = F.coalesce("modelRejection", "rejection")
    shown = F.coalesce("surfaced", F.lit(False))
    outcome = F.when(shown, "surfaced").when(refusal.isNotNull(), "refused").otherwise("quiet")
    proposed = F.coalesce("rejectedText", F.when(F.col("stages.model") & (F.col("replacement") != ""), F.col("replacement")))
    stage = F.coalesce(*[F.when(F.col(f"stages.{s}"), F.lit(s)) for s in STAGES])
    return rows.select(
        "run", "id", "issueClass", "source", proposed.alias("proposed"), F.when(shown, F.nullif("replacement", F.lit(""))).alias("shown"), outcome.alias("outcome"),
        refusal.alias("rejection"), stage.alias("stage"), "lostWords", "verifierReason", "milliseconds",
    )


def run_totals(outcome_rows: DataFrame) -> DataFrame:
    """Of each run its rows by outcome, and refused rows of which the refused text is known."""
    of = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    known = F.count_if((F.col("outcome") == "refused") & F.col("proposed").isNotNull())
    return outcome_rows.groupBy("run").agg(F.count("*").alias("total"), of("surfaced"), of("refused"), of("quiet"), known.alias("refused_with_text"))


def reason_by_run(outcome_rows: DataFrame) -> DataFrame:
    """The ledger: how often each reason refused in each run, with the reason's total and the runs that have it."""
    cells = outcome_rows.where("outcome = 'refused'").groupBy(F.col("rejection").alias("reason"), "run").agg(F.count("*").alias("n"))
    sums = cells.groupBy("reason").agg(F.sum("n").alias("total"), F.count("*").alias("runs"))
    return cells.join(sums, "reason").select("reason", "run", "n", "total", "runs")


def _pairs(rows: DataFrame, text: str, keep: Column, **more: Column) -> DataFrame:
    # of equal pairs the one of the first file, and in it of the first id
    first = F.struct("file", "id", *[c.alias(name) for name, c in more.items()])
    picked = rows.where(keep & F.col("source").isNotNull()).groupBy("source", text).agg(F.min(first).alias("f"))
    key = P.fnv1a(F.concat(F.col("source"), F.lit("\0"), F.col(text)))
    return picked.select(key.alias("key"), "source", F.col(text).alias("candidate"), F.regexp_extract("f.file", "([^/]*)$", 1).alias("from"), *[F.col(f"f.{name}") for name in more])


def accepted_pairs(rows: DataFrame) -> DataFrame:
    """Every distinct pair of a sentence and a rewrite of the model that some run showed: ``key``, ``source``, ``candidate`` and the file it is ``from``."""
    return _pairs(rows, "replacement", F.coalesce(F.col("surfaced") & F.col("stages.model") & (F.col("replacement") != ""), F.lit(False)))


def refused_pairs(rows: DataFrame) -> DataFrame:
    """Every distinct pair of a sentence and a refused rewrite, with the ``reason`` then given."""
    return _pairs(rows, "rejectedText", F.coalesce(F.col("rejectedText") != "", F.lit(False)), reason=F.coalesce("modelRejection", "rejection"))


def scored_runs(rows: DataFrame) -> DataFrame:
    """The summary of each run."""
    model, mechanics = F.coalesce(F.col("stages.model"), F.lit(False)), F.coalesce(F.col("stages.mechanics"), F.lit(False))
    shaped = rows.select("run", "expectedAction", "action", F.coalesce("surfaced", F.lit(False)).alias("surfaced"), F.coalesce("modelRejection", "rejection").alias("rejection"), "milliseconds", model.alias("by_model"), mechanics.alias("by_mechanics"))
    return reports.scored(shaped, ["run"])


def reasons(rows: DataFrame) -> DataFrame:
    """Of each run how often each sentence ended in a refusal (``rejections``), the model was refused (``modelRejections``), and a call failed (``failureKinds``)."""
    told = [("rejections", "rejection", F.col("action") != "failed"), ("modelRejections", "modelRejection", F.col("action") != "failed"), ("failureKinds", "rejection", F.col("action") == "failed")]
    each = F.array(*[F.when(test & F.col(c).isNotNull(), F.struct(F.lit(name).alias("kind"), F.col(c).alias("value"))) for name, c, test in told])
    return rows.select("run", F.explode(F.filter(each, lambda e: e.isNotNull())).alias("e")).groupBy("run", "e.kind", "e.value").agg(F.count("*").alias("n"))
