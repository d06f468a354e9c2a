"""URL filters: fixed host and path rules, and a path-template tree for the rest.

Per host, paths grow a tree. Level by level a segment becomes a wildcard where it looks variable (numbers, hashes,
dates) or where its parent has so many different children that names carry no pattern; children whose labelled
shares don't differ significantly from the rest of their siblings are merged into one branch. What remains are
templates. A template is rejected when the smoothed share of good pages among its labelled ones, drawn
towards its host's and then the whole table's share, is under ``min_purity``.

In a template '/*' is a wildcard and '/~' the merged branch; a segment's own name that begins with '*', '~' or a backslash has a
backslash before it.

All counting runs on one row per host and path skeleton, not per page. Everything is a column expression.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.llm.licenses import LOWER, UPPER
from sessionscope.operators.staging import shared_dir, stage


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed values.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))
VARIABLE = r"\A(?:[0-9]+(?:\.[a-z0-9]+)?|[0-9a-f]{8,}|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|[0-9a-f]{8}-[0-9a-f-]{27}|.{40,})\z"


@dataclass(frozen=True)
class TemplateConfig:
    fan_out: int = 12  # different children from which a level may be variable
    distinct_share: float = 0.3  # of different children among the pages of their parent
    z: float = 1.96
    pull: float = 8.0  # labelled pages that the share of the level above counts for
    min_purity: float = 0.5


def url_host(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.char_length(rest) + 4)
    host = F.translate(F.regexp_extract(after, r"\A([^/?#]*)", 1), UPPER, LOWER)
    return F.when(F.contains(url, F.lit("://")), host).otherwise("")


def url_path(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.char_length(rest) + 4)
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, r"\A[^/?#]*([^?#]*)", 1)).otherwise("")


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits (name, verdict), or null."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def skeleton(path: Column) -> Column:
    """The segments of a path: '*' for those that look variable, the others' names, marked where one reads like a wildcard."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).when(s.rlike(r"\A[*~\\]"), F.concat(F.lit("\\"), s)).otherwise(s))


def _steps(segments: Column) -> Column:
    """Template text of segments that have no siblings."""
    return F.array_join(F.transform(segments, lambda s: F.when(s == "*", "/*").otherwise("/~")), "")


def grow_templates(skeletons: DataFrame, config: TemplateConfig) -> DataFrame:
    """(host, segments, good, bad, n) -> the same with ``template``, from branching to branching.

    In a round, every branch (host, template) first goes on by what all its paths have in common there, which has no siblings and so
    nothing to decide; the least and the greatest path tell how far. One that has a single path left ends. The others
    branch: their next segments are told apart or merged. A path that is at its end there is a child of its own ('') and is set
    aside. So the rounds follow the branchings, not the segments, and what has ended stands in one table.
    """
    if config.fan_out < 2:
        raise ValueError("a single child is no fan")
    spark, folder, rounds = skeletons.sparkSession, f"{shared_dir(skeletons.sparkSession)}/url-templates-{uuid.uuid4().hex}", 0
    state = skeletons.withColumns({"rest": F.col("segments"), "template": F.lit("")})
    schema = None
    while True:
        ends = state.groupBy(F.col("host").alias("h"), F.col("template").alias("t")).agg(F.min("rest").alias("least"), F.max("rest").alias("most"))
        differ = F.array_position(F.zip_with("least", "most", lambda a, b: a.eqNullSafe(b)), F.lit(False))
        common = F.when(differ > 0, differ - 1).otherwise(F.size("least")).cast("int")  # one path: to its end
        ends = ends.select("h", "t", common.alias("common"), (differ == 0).alias("single"))
        gone = state.join(ends, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")))
        after = F.when(F.col("common") < F.size("rest"), F.slice("rest", F.col("common") + 1, F.size("rest"))).otherwise(F.array().cast("array<string>"))
        now = gone.withColumns({"template": F.concat("template", _steps(F.slice("rest", 1, F.col("common")))), "rest": after})
        now = stage(now.select("host", "segments", "n", "good", "bad", "rest", "template", "single"), "url-branches")
        done = now.where("single").withColumn("ended", F.lit(True)).drop("single")
        now = now.where("not single").drop("single").withColumn("segment", F.coalesce(F.get("rest", F.lit(0)), F.lit("")))
        children = now.groupBy("host", "template", "segment").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        parents = children.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("n").alias("pn"), F.sum("good").alias("pgood"), F.sum("bad").alias("pbad"))
        both = children.join(parents, ["host", "template"])
        variable = (F.col("kinds") >= config.fan_out) & (F.col("kinds") >= config.distinct_share * F.col("pn"))
        known = F.col("good") + F.col("bad")
        others = F.col("pgood") + F.col("pbad") - known
        share = (F.col("pbad") + 0.5) / (F.col("pgood") + F.col("pbad") + 1)
        gap = F.abs(F.try_divide(F.col("bad").cast("double"), known) - F.try_divide(F.col("pbad") - F.col("bad"), others))
        error = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), known) + F.try_divide(F.lit(1.0), others)))
        alone = F.coalesce(gap > F.lit(config.z) * error, F.lit(False))  # no labels on a side: nothing tells them apart
        to = F.when(F.col("segment") == "", "").when(F.col("segment") == "*", "/*").when(variable, "/*").when(alone, F.concat(F.lit("/"), F.col("segment"))).otherwise("/~")
        moves = both.select(F.col("host").alias("h"), F.col("template").alias("t"), F.col("segment").alias("s"), to.alias("step"))
        joined = now.join(moves, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & (F.col("segment") == F.col("s")))
        grown = joined.select("host", "segments", "n", "good", "bad", F.slice("rest", 2, F.greatest(F.size("rest"), F.lit(1))).alias("rest"), F.concat("template", "step").alias("template"), (F.size("rest") == 0).alias("ended"))
        both_kinds = grown.unionByName(done)
        both_kinds.write.parquet(f"{folder}/round={rounds}")
        schema = schema or both_kinds.schema
        state = spark.read.schema(schema).parquet(f"{folder}/round={rounds}").where("not ended").drop("ended")
        rounds += 1
        if state.isEmpty():
            return spark.read.schema(schema).parquet(folder).where("ended").select("host", "segments", "n", "good", "bad", "template")


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id: str = "doc_id",
    good_col: str = "quality",
    rules: tuple[Rule, ...] = RULES,
    config: TemplateConfig = TemplateConfig(),  # noqa: B008
) -> DataFrame:
    """One row for every page: id, ``host``, ``path``, ``rule`` (name or null), ``verdict``, ``template``, ``purity``.

    Rules decide first, templates the rest. ``labels`` marks pages as good (1) or bad (0) by id; null labels and
    labels of other ids play no part. A null url, or one without '://', has an empty host and path, which is a
    template like any other. Repeated rows are judged alike; without any label everything outside the rules is allowed.
    """
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col).alias("id"), F.coalesce(url_host(url), F.lit("")).alias("host"), F.coalesce(url_path(url), F.lit("")).alias("path"))
    base = base.withColumn("segments", skeleton(F.col("path")))
    known = labels.where(F.col(label_id).isNotNull() & F.col(good_col).isNotNull()).groupBy(F.col(label_id).alias("lid")).agg(F.max(good_col).alias("g"))
    labelled = base.select("id", "host", "segments").join(known, F.col("id") == F.col("lid"), "left")
    skeletons = labelled.groupBy("host", "segments").agg(
        F.count("*").alias("n"), F.count_if(F.col("g") > 0).alias("good"), F.count_if(F.col("g") <= 0).alias("bad")
    )
    grown = grow_templates(stage(skeletons, "url-skeletons"), config)
    by_template = grown.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    by_host = by_template.groupBy("host").agg(F.sum("good").alias("hgood"), F.sum("bad").alias("hbad"))
    top = grown.agg(((F.sum("good") + 1) / (F.sum("good") + F.sum("bad") + 1)).alias("p")).first()["p"]
    top = 1.0 if top is None else min(1.0, top)
    host_share = (F.col("hgood") + config.pull * top) / (F.col("hgood") + F.col("hbad") + config.pull)
    purity = (F.col("good") + config.pull * host_share) / (F.col("good") + F.col("bad") + config.pull)
    pure = by_template.join(by_host, "host").select("host", "template", purity.alias("purity"))
    verdicts = grown.select("host", "segments", "template").join(pure, ["host", "template"]).select(F.col("host").alias("h"), F.col("segments").alias("s"), "template", "purity")
    judged = base.join(verdicts, (F.col("host") == F.col("h")) & (F.col("segments") == F.col("s")), "left")
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < config.min_purity, "block").otherwise("allow")
    return judged.withColumn("r", rule).select(
        F.col("id").alias(id_col), "host", "path", F.col("r.name").alias("rule"), F.coalesce(F.col("r.verdict"), own).alias("verdict"), "template", "purity"
    )
