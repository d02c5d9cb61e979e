"""Composite outputs per problem: dossier sections and their text, reasoning state, evidence relations, as tagged unions of the parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.numeric import significant
from gleaner.operators import evidence as E
from gleaner.operators.common import dealt, top_k
from gleaner.operators.stages import Stages

#: Bytes of series' texts that are broadcast at most.
FEW_BYTES = 32 << 20
#: The order of a dossier's sections.
SECTIONS = ["problem", "series", "claims", "findings", "interventions", "gaps", "coverage"]


def sections(problems: DataFrame, questions: DataFrame, links: DataFrame, findings: DataFrame, studies: DataFrame) -> DataFrame:
    """(problem_id, section, n, body): statement, questions, findings with their study, and gaps, each ordered and joined into text."""
    statement = problems.select("problem_id", F.lit("statement").alias("section"), F.lit(1).cast("long").alias("n"), F.col("statement").alias("body"))
    asked = questions.groupBy("problem_id").agg(F.array_sort(F.collect_list(F.struct("asked", "question_id", "question"))).alias("q"))
    asked = asked.select("problem_id", F.lit("questions").alias("section"), F.size("q").cast("long").alias("n"), F.array_join(F.transform("q", lambda x: x["question"]), "\n").alias("body"))
    cited = E.finding_citations(findings, studies, links, questions).select("problem_id", "finding_id", F.concat_ws(" | ", "title", "outcome", "intervention").alias("said")).distinct()
    cited = cited.groupBy("problem_id").agg(F.array_sort(F.collect_list(F.struct("finding_id", "said"))).alias("f"))
    cited = cited.select("problem_id", F.lit("findings").alias("section"), F.size("f").cast("long").alias("n"), F.array_join(F.transform("f", lambda x: x["said"]), "\n").alias("body"))
    bare = questions.join(links, "question_id", "left_anti").groupBy("problem_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("question_id")), lambda x: x.cast("string")), ",").alias("body"))
    bare = bare.select("problem_id", F.lit("gaps").alias("section"), "n", "body")
    return statement.unionByName(asked).unionByName(cited).unionByName(bare)


def _lines(df: DataFrame, keys: list[str], order: list[str], line: Column) -> DataFrame:
    """(keys, body): lines of a group in order, joined by line ends."""
    each = F.array_sort(F.collect_list(F.struct(*order, line.alias("said"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(each, lambda x: x["said"]), "\n").alias("body"))


def series_text(measurements: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, body): a series as its tag with the ids, its points with six significant digits, and its source; projections aside."""
    m = measurements.filter(~F.col("status").eqNullSafe("projection"))
    points = F.array_sort(F.collect_list(F.struct("period", "value", "measurement_id", "provisional")))
    s = m.groupBy(*keys).agg(points.alias("p")).join(F.broadcast(registry.select("indicator", "label")), "indicator", "left")
    ids = F.array_join(F.transform("p", lambda x: x["measurement_id"]), ",")
    said = F.array_join(F.transform("p", lambda x: F.concat(x["period"], F.lit(":"), significant(x["value"]))), ", ")
    last = F.element_at("p", -1)
    note = F.when(last["provisional"], F.concat(F.lit("\n  NOTE: the last point ("), last["period"], F.lit(") is the provider's first estimate.")))
    body = F.concat(F.lit("[MEASUREMENTS "), ids, F.lit("] "), F.concat_ws(" / ", *keys), F.coalesce(F.concat(F.lit("\n  "), F.col("label")), F.lit("")), F.lit("\n  series: "), said, F.lit("\n  source: "), F.col("source"), F.coalesce(note, F.lit("")))
    return s.select(*keys, body.alias("body"))


def finding_line(tag_id: Column, statement: Column, **meta: Column) -> Column:
    """[FINDING id] (name=value; ...) statement; what is null isn't named."""
    said = F.concat_ws("; ", *[F.concat(F.lit(f"{name}="), value) for name, value in meta.items()])
    return F.concat(F.lit("[FINDING "), tag_id.cast("string"), F.lit("] ("), said, F.lit(") "), statement)


def claim_line(tag_id: Column, scope: Column, proposition: Column, url: Column) -> Column:
    return F.concat(F.lit("[CLAIM "), tag_id.cast("string"), F.lit("] ["), F.coalesce(scope, F.lit("?")), F.lit("] "), proposition, F.lit("\n  (source: "), F.coalesce(url, F.lit("n/a")), F.lit(")"))


def _parts(
    problems: DataFrame, subjects: DataFrame, measurements: DataFrame, registry: DataFrame, questions: DataFrame, links: DataFrame, findings: DataFrame, studies: DataFrame, claims: DataFrame, levers: DataFrame, shown: int = 14
) -> tuple[DataFrame, DataFrame]:
    """(problem_id, section, body) of all sections but series, and (subject, body) of series, written once per subject."""
    at = lambda df, name: df.select("problem_id", F.lit(name).alias("section"), "body")
    head = problems.select("problem_id", F.concat(F.lit("PROBLEM (id="), F.col("problem_id").cast("string"), F.lit("): "), "statement").alias("body"))
    keys = ["indicator", "subject", "source"]
    series = _lines(series_text(measurements, registry, keys), ["subject"], ["indicator", "source"], F.col("body"))
    first = top_k(claims, ["problem_id"], [F.asc("claim_id")], shown)
    said = _lines(first, ["problem_id"], ["claim_id"], claim_line(F.col("claim_id"), F.col("scope"), F.col("proposition"), F.col("url")))
    cited = E.finding_citations(findings, studies, links, questions)
    one = cited.select("problem_id", "finding_id", "statement", "outcome", "intervention", "year").distinct()
    found = _lines(one, ["problem_id"], ["finding_id"], finding_line(F.col("finding_id"), F.col("statement"), outcome=F.col("outcome"), intervention=F.col("intervention"), year=F.col("year").cast("string")))
    verified = levers.filter(F.coalesce(F.trim("relevance"), F.lit("")) != "")
    act = _lines(verified, ["problem_id"], ["name"], F.concat(F.lit("  - "), F.col("name"), F.lit(" (relevance: "), F.trim("relevance"), F.lit(")")))
    bare = questions.join(links, "question_id", "left_anti")
    gaps = _lines(bare, ["problem_id"], ["question_id"], F.concat(F.lit("  - Q"), F.col("question_id").cast("string"), F.lit(": no evidence")))
    answered = links.groupBy("question_id").agg(F.count_if(F.col("evidence_type") == "measurement").alias("m"), F.count_if(F.col("evidence_type") == "finding").alias("f"))
    c = questions.join(answered, "question_id", "left").groupBy("problem_id").agg(F.count("*").alias("q"), F.count("m").alias("a"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.coalesce(F.sum("f"), F.lit(0)).alias("f"))
    text = lambda n: F.col(n).cast("string")
    coverage = c.select("problem_id", F.concat(F.lit("COVERAGE: "), text("a"), F.lit("/"), text("q"), F.lit(" questions answered; "), text("m"), F.lit(" measurements, "), text("f"), F.lit(" findings")).alias("body"))
    parts = zip([x for x in SECTIONS if x != "series"], (head, said, found, act, gaps, coverage), strict=True)
    return reduce(DataFrame.unionByName, [at(df, name) for name, df in parts]), series


def full(
    problems: DataFrame, subjects: DataFrame, measurements: DataFrame, registry: DataFrame, questions: DataFrame, links: DataFrame, findings: DataFrame, studies: DataFrame, claims: DataFrame, levers: DataFrame, shown: int = 14
) -> DataFrame:
    """(problem_id, section, body): all sections of each problem's dossier that have something to say.

    claims: problem_id, claim_id, scope, proposition, url; levers: problem_id, name, relevance. Series are written once per subject and
    joined to its problems.
    """
    parts, series = _parts(problems, subjects, measurements, registry, questions, links, findings, studies, claims, levers, shown)
    return parts.unionByName(subjects.join(series, "subject").select("problem_id", F.lit("series").alias("section"), "body"))


def _placed(parts: DataFrame) -> DataFrame:
    return parts.withColumn("place", F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section")))


def rendered(parts: DataFrame) -> DataFrame:
    """(problem_id, body): a dossier's sections as one text, in their order."""
    return _lines(_placed(parts), ["problem_id"], ["place"], F.col("body"))


def rendered_whole(problems: DataFrame, subjects: DataFrame, measurements: DataFrame, *tables: DataFrame, shown: int = 14) -> DataFrame:
    """rendered of full, of the same tables, with its series put in last.

    The texts of series are long and few, one for each set of subjects that problems have, so they meet dossiers whose other sections are put together already, and no copy of them is shuffled for a problem.
    """
    parts, series = _parts(problems, subjects, measurements, *tables, shown=shown)
    stages = Stages(problems.sparkSession)
    # a set of subjects goes by its digest; a subject named twice is told twice, as in full
    named = subjects.groupBy("problem_id").agg(F.sort_array(F.collect_list("subject")).alias("subjects")).select("problem_id", "subjects", F.sha2(F.to_json("subjects"), 256).alias("set"))
    sets = named.groupBy("set").agg(F.first("subjects").alias("subjects")).select("set", F.posexplode("subjects").alias("n", "subject"))
    texts = stages.put(_lines(sets.join(series, "subject"), ["set"], ["body", "n"], F.col("body")).withColumnRenamed("body", "series"))
    width = texts.agg(F.sum(F.octet_length("series"))).first()[0] or 0
    place = SECTIONS.index("series") + 1
    each = _placed(parts).groupBy("problem_id").agg(F.array_sort(F.collect_list(F.struct("place", "body"))).alias("b"))
    side = lambda some: F.transform(F.filter("b", some), lambda x: x["body"])
    both = each.select("problem_id", side(lambda x: x["place"] < place).alias("before"), side(lambda x: x["place"] > place).alias("after")).join(named.select("problem_id", "set"), "problem_id", "full")
    both = both.join(F.broadcast(texts) if width <= FEW_BYTES else texts, "set", "left").filter("before IS NOT NULL OR series IS NOT NULL")
    none = F.array().cast("array<string>")
    lines = F.concat(F.coalesce("before", none), F.array_compact(F.array("series")), F.coalesce("after", none))
    return both.select("problem_id", F.array_join(lines, "\n").alias("body"))


def finding_text(statement: Column, intervention: Column, outcome: Column, strength: Column, limitations: Column) -> Column:
    """A finding as one line; what is null or blank isn't named."""
    some = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws(" | ", F.concat(F.lit("FINDING: "), statement), some("intervention/claim", intervention), some("outcome", outcome), some("strength", strength), some("limitations", limitations))


def measurement_text(indicator: Column, subject: Column, period: Column, value: Column, unit: Column) -> Column:
    said = F.format_number(value, 2)
    return F.rtrim(F.concat(F.lit("MEASUREMENT: "), indicator, F.lit(" | "), F.coalesce(subject, F.lit("")), F.lit(" | "), period, F.lit(": "), said, F.lit(" "), F.coalesce(unit, F.lit(""))))


def candidate_pairs(cited_findings: DataFrame, measurements: DataFrame) -> DataFrame:
    """(a, b, kind): pairs of evidence worth comparing, as type:id with a < b, each once: findings that share an intervention or outcome
    within a question, readings of one indicator, subject and period from two sources, newest readings of two indicators of a subject and source."""
    pair = lambda df, kind, a, b: df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.lit(kind).alias("kind"))
    tag = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    findings = pair(E.pairs_sharing(cited_findings, ["intervention", "outcome"]), "finding", tag("finding", "a_id"), tag("finding", "b_id"))
    mid = lambda i, s, o, p: F.concat(F.lit("measurement:"), F.concat_ws("|", i, s, o, p))
    sources = pair(E.cross_source_pairs(measurements), "same_period", mid("indicator", "subject", "source", "period"), mid("indicator", "subject", "other_source", "period"))
    kinds = pair(E.representative_pairs(measurements), "different_indicator", mid("indicator", "subject", "source", "period"), mid("b_indicator", "subject", "source", "b_period"))
    return findings.unionByName(sources).unionByName(kinds).distinct()


def related(pairs: DataFrame, judged: DataFrame, old: DataFrame) -> DataFrame:
    """(a, b, relation, is_new): each pair, whichever way round, with its stored relation, else the classifier's, else not_comparable; reruns add nothing."""
    both = lambda df, c: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("relation").alias(c)).groupBy("a", "b").agg(F.min(c).alias(c))
    p = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    joined = p.join(both(old, "__old"), ["a", "b"], "left").join(both(judged, "__new"), ["a", "b"], "left")
    return joined.select("a", "b", F.coalesce("__old", "__new", F.lit("not_comparable")).alias("relation"), F.col("__old").isNull().alias("is_new"))


def reasoning(questions: DataFrame, links: DataFrame, findings: DataFrame) -> DataFrame:
    """Per problem: direct evidence, supporting studies, conflicting pairs (an intervention with several outcomes) and unresolved questions."""
    q = questions.select("question_id", "problem_id")
    rows = links.count()
    found = E.cited(dealt(links.select("question_id", "evidence_type", "evidence_id"), "question_id", rows), questions, "finding")
    cited = dealt(found.select("question_id", "problem_id", "evidence_id"), "evidence_id", rows).join(findings.select("finding_id", "study_id", "intervention", "outcome"), F.col("evidence_id") == F.col("finding_id"))
    # dealt out before they are counted: hardly any row is the same as another, so counts don't combine before the shuffle
    each = F.explode(F.array(F.struct(F.lit(True).alias("finding"), F.col("finding_id").alias("id")), F.struct(F.lit(False).alias("finding"), F.col("study_id").alias("id")))).alias("x")
    named = dealt(cited.select("problem_id", "finding_id", "study_id"), "problem_id", rows).select("problem_id", each).select("problem_id", "x.finding", "x.id").filter("id IS NOT NULL").distinct()
    direct = named.groupBy("problem_id").agg(F.count_if("finding").alias("direct_evidence"), F.count_if(~F.col("finding")).alias("supporting_studies"))
    per = dealt(cited.filter("intervention IS NOT NULL").select("problem_id", "question_id", "intervention", "outcome"), "problem_id", rows).groupBy("problem_id", "question_id", "intervention").agg(F.countDistinct("outcome").alias("k"))
    conflict = per.groupBy("problem_id").agg(F.count_if(F.col("k") > 1).alias("conflicts"))
    bare = q.join(dealt(links.select("question_id"), "question_id", rows), "question_id", "left_anti").groupBy("problem_id").agg(F.count("*").alias("unresolved"))
    out = q.select("problem_id").distinct()
    for part in (direct, conflict, bare):
        out = out.join(part, "problem_id", "left")
    return out.na.fill(0)


def reasoning_items(questions: DataFrame, links: DataFrame, findings: DataFrame, relations: DataFrame, subjects: DataFrame, series: DataFrame) -> DataFrame:
    """(question_id, section, item): what is known about each question, as tagged lines.

    questions: question_id, status; links: question_id, evidence_type, evidence_id; findings: finding_id, study_id, statement, geography;
    relations: question_id, a, b (type:id), relation; subjects: question_id, subject; series: question_id, indicator, period, value.

    direct_evidence: the findings cited. deterministic_patterns: coverage, supporting studies, counts of relations. evidence_relationships: the
    relations as they are. supported_inferences: first and last reading of a series, and that conflicts exist. unresolved: questions without evidence or
    deferred, conflicts without a winner, pairs that can't be compared. unsupported_claims: findings scoped to another place than the
    question's subject, and series of a compared pair that move in opposite directions, which shows no cause.
    """
    item = lambda df, section, text: df.select("question_id", F.lit(section).alias("section"), text.alias("item"))
    text = lambda c: F.col(c).cast("string")
    found = links.filter("evidence_type = 'finding'").join(findings, F.col("evidence_id") == F.col("finding_id")).select("question_id", "finding_id", "study_id", "statement", "geography").distinct()
    direct = item(found, "direct_evidence", F.concat(F.lit("finding:"), text("finding_id"), F.lit(" "), F.col("statement")))
    counts = questions.select("question_id").join(links.groupBy("question_id").agg(F.countDistinct(F.when(F.col("evidence_type") == "measurement", F.col("evidence_id"))).alias("m"), F.countDistinct(F.when(F.col("evidence_type") == "finding", F.col("evidence_id"))).alias("f")), "question_id", "left").na.fill(0)
    coverage = item(counts, "deterministic_patterns", F.concat(F.lit("coverage measurements="), text("m"), F.lit(" findings="), text("f")))
    studies = questions.select("question_id").join(found.groupBy("question_id").agg(F.countDistinct("study_id").alias("k")), "question_id", "left").na.fill(0)
    supported = item(studies, "deterministic_patterns", F.concat(F.lit("studies="), text("k")))
    kinds = questions.select("question_id").join(relations.groupBy("question_id").agg(F.count_if(F.col("relation") == "conflict").alias("c"), F.count_if(F.col("relation") == "agree").alias("g")), "question_id", "left").na.fill(0)
    conflicts = item(kinds, "deterministic_patterns", F.concat(F.lit("conflict_pairs="), text("c")))
    agreements = item(kinds, "deterministic_patterns", F.concat(F.lit("agree_pairs="), text("g")))
    edge = F.concat_ws(" ", "a", "relation", "b")
    edges = item(relations, "evidence_relationships", edge)
    ends = series.groupBy("question_id", "indicator").agg(F.count("value").alias("n"), F.min_by(F.struct("period", "value"), "period").alias("x"), F.max_by(F.struct("period", "value"), "period").alias("y")).filter("n >= 2")
    moved = F.concat_ws(" ", "indicator", "x.period", F.format_number("x.value", 0), F.lit("->"), "y.period", F.format_number("y.value", 0))
    inferred = item(ends, "supported_inferences", moved)
    present = item(kinds.filter("c > 0"), "supported_inferences", F.lit("has_conflict"))
    why = F.when(F.col("status").isin("no_evidence", "deferred"), F.col("status"))
    state = item(questions.withColumn("why", why).filter("why IS NOT NULL"), "unresolved", F.col("why"))
    open_ = item(relations.filter("relation IN ('conflict', 'not_comparable')"), "unresolved", F.concat(F.lit("undecided "), edge))
    scoped = found.join(subjects, "question_id").filter((F.trim(F.coalesce("geography", F.lit(""))) != "") & (F.lower(F.trim("geography")) != F.lower("subject")))
    guard = item(scoped, "unsupported_claims", F.concat(F.lit("finding:"), text("finding_id"), F.lit(" place="), F.trim("geography"), F.lit(" asked="), F.col("subject")))
    way = ends.select("question_id", "indicator", F.signum(F.col("y.value") - F.col("x.value")).alias("way"))
    other = way.select("question_id", F.col("indicator").alias("other"), F.col("way").alias("other_way"))
    against = way.join(other, "question_id").filter((F.col("indicator") < F.col("other")) & (F.col("way") * F.col("other_way") < 0))
    apart = item(against, "unsupported_claims", F.concat_ws(" against ", "indicator", "other"))
    return reduce(DataFrame.unionByName, [direct, coverage, supported, conflicts, agreements, edges, inferred, present, state, open_, guard, apart])


def blocks(items: DataFrame, keys: list[str], order: list[str], line: Column, head: str) -> DataFrame:
    """(keys, body): a heading and a dash per item, in order, for prompts and posts."""
    listed = _lines(items, keys, order, F.concat(F.lit("- "), line))
    return listed.select(*keys, F.concat(F.lit(head + "\n"), "body").alias("body"))


def context_pack(text: Column, dropped: tuple[str, ...] = ("CASE", "INSIGHT", "LEDGER")) -> Column:
    """Text without the lines that start with one of the words."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.ltrim(x).rlike(f"^({'|'.join(dropped)})"))
    return F.array_join(kept, "\n")


def deduplicated_evidence(evidence: DataFrame, keys: list[str], order: str, text: str, head: int = 120) -> DataFrame:
    """Evidence lines of a post, of which those that start alike in so many characters appear once, the first."""
    return top_k(evidence.withColumn("__head", F.substring(F.col(text), 1, head)), [*keys, "__head"], [F.asc(order)], 1).drop("__head")


def post_bodies(problems: DataFrame, evidence: DataFrame, levers: DataFrame, gaps: DataFrame, key: str, most: int = 12) -> DataFrame:
    """(key, body, flags): a post of headline, evidence, levers and open questions, each with a line of its own where there are none.

    problems: key, statement; evidence: key, place, text (lines that start alike come once, the first ``most`` are shown); levers: key, lever, verified; gaps: key,
    place, question. Flags: no_evidence, unverified:n, open:n.
    """
    lines = deduplicated_evidence(evidence, [key], "place", "text").withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("place"))).filter(F.col("__n") <= most)
    told = _lines(lines, [key], ["place"], F.concat(F.lit("- "), "text")).withColumnRenamed("body", "__evidence")
    named = levers.groupBy(key, "lever").agg(F.bool_or("verified").alias("verified"))
    ways = _lines(named, [key], ["lever"], F.concat(F.lit("- "), "lever", F.when(F.col("verified"), "").otherwise(" (not verified)"))).withColumnRenamed("body", "__levers")
    weak = named.groupBy(key).agg(F.count_if(~F.col("verified")).alias("__weak"))
    open_ = _lines(gaps, [key], ["place"], F.concat(F.lit("- "), "question")).withColumnRenamed("body", "__gaps")
    many = gaps.groupBy(key).agg(F.count("*").alias("__open"))
    df = problems.select(key, "statement")
    for part in (told, ways, weak, open_, many):
        df = df.join(part, key, "left")
    body = F.concat(
        F.lit("# "), F.trim("statement"), F.lit("\n\n## Evidence\n"), F.coalesce("__evidence", F.lit("None is linked yet.")), F.lit("\n\n## Levers\n"), F.coalesce("__levers", F.lit("None is known yet.")),
        F.lit("\n\n## Open questions\n"), F.coalesce("__gaps", F.lit("None.")),
    )
    flags = F.array_compact(F.array(F.when(F.col("__evidence").isNull(), "no_evidence"), F.when(F.col("__weak") > 0, F.concat(F.lit("unverified:"), "__weak")), F.when(F.col("__open") > 0, F.concat(F.lit("open:"), "__open"))))
    return df.select(key, body.alias("body"), F.array_join(flags, ",").alias("flags"))
