"""Problems: summaries of admitted discussions, demand, listings, evidence, and the pair scorer and classifier behind them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom import fixed
from storyloom.functions.text import cue_count, jaccard
from storyloom.functions.vectors import dot

POOL = 500


def engagement(clamped: bool) -> Column:
    """Points, comments and reactions; negative points count 0 in summaries but not in evidence."""
    points = F.coalesce("points", F.lit(0))
    return (F.greatest(points, F.lit(0)) if clamped else points) + F.coalesce("comments", F.lit(0)) + F.coalesce("reactions", F.lit(0))


def summary(discussions: DataFrame) -> DataFrame:
    """Per problem, in one pass by voice and one by problem; a post without author is a voice of its own."""
    members = discussions.where(F.col("problem_id").isNotNull()).withColumn("voice", F.coalesce("author_hash", F.col("id").cast("string"))).withColumn("eng", engagement(True))
    voices = members.groupBy("problem_id", "voice").agg(F.max("p_problem").alias("p")).groupBy("problem_id").agg(F.count("*").alias("voice_count"), F.sum("p").alias("effective_voices"))
    categories = members.groupBy("problem_id", "category").agg(F.round(F.sum("p_problem"), 9).alias("w")).groupBy("problem_id").agg(F.min_by("category", F.struct(-F.col("w"), "category")).alias("category"))
    best = F.struct(-F.col("p_problem"), -F.col("eng"), "observed_at", "id")
    whole = members.groupBy("problem_id").agg(
        F.count("*").alias("member_count"),
        F.countDistinct("source_id").alias("source_count"),
        F.countDistinct("platform").alias("platform_count"),
        F.sum("eng").alias("engagement"),
        F.min_by(F.struct("id", "body", "is_comment"), best).alias("rep"),
        F.min("observed_at").alias("first_seen_at"),
        F.max("observed_at").alias("last_seen_at"),
    )
    joined = whole.join(voices, "problem_id").join(categories, "problem_id")
    return joined.select(
        "problem_id", "member_count", "voice_count", "effective_voices", "source_count", "platform_count", "engagement", "category",
        F.col("rep.id").alias("representative_id"), F.left("rep.body", F.lit(160)).alias("statement"), "first_seen_at", "last_seen_at",
    )


HEADLINE = 160


def headline(title: Column, lede: Column, is_comment: Column) -> Column:
    """What a document says the problem is: a post's title, but the start of a comment, whose title is its thread's."""
    return F.when(is_comment, F.left(lede, F.lit(HEADLINE))).otherwise(title)


def demand(problems: DataFrame, as_of: Column) -> DataFrame:
    """Adds the five factors and their product, the demand."""
    weights = F.create_map(*[F.lit(x) for pair in fixed.CATEGORY_WEIGHTS.items() for x in pair])
    age = F.greatest((F.unix_micros(as_of) - F.unix_micros("last_seen_at")) / F.lit(8.64e10), F.lit(0.0))
    floored = lambda c: F.greatest(F.col(c), F.lit(0))
    out = problems.withColumns(
        {
            "f_voices": F.log1p(floored("effective_voices")),
            "f_sources": 1 + 0.5 * F.log1p(floored("source_count")),
            "f_recency": F.pow(F.lit(0.5), age / 30.0),
            "f_engagement": 1 + 0.2 * F.log1p(floored("engagement")),
            "f_category": F.coalesce(F.try_element_at(weights, F.coalesce("category", F.lit(""))), F.lit(fixed.OTHER_CATEGORY)),
        }
    )
    return out.withColumn("demand", F.col("f_voices") * F.col("f_sources") * F.col("f_recency") * F.col("f_engagement") * F.col("f_category"))


def listing(problems: DataFrame, as_of: Column, since_days: int = 30, min_voices: int = 1, category: str | None = None, relevance: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """rank, problem_id, demand, relevance, final. The pool is cut by stored demand (as of the problem's last sighting),
    then scored anew; with relevance (problem_id, relevance) the final score is relevance * sqrt(demand)."""
    rows = problems.where(F.col("last_seen_at") >= as_of - F.make_dt_interval(days=F.lit(since_days))).where(F.col("voice_count") >= min_voices)
    if category is not None:
        rows = rows.where(F.col("category") == category)
    if relevance is not None:
        rows = rows.join(relevance.where("relevance >= 0.5"), "problem_id")
    else:
        rows = rows.withColumn("relevance", F.lit(None).cast("double"))
    stored = demand(rows, F.col("last_seen_at")).withColumn("stored", F.round("demand", 6))
    pool = stored.orderBy(F.desc("stored"), "problem_id").limit(POOL).drop("demand", "stored")
    final = F.when(F.col("relevance").isNull(), F.col("demand")).otherwise(F.col("relevance") * F.sqrt("demand"))
    scored = demand(pool, as_of).withColumn("final", F.round(final, 6))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final"), "problem_id"))).where(F.col("rank") <= limit)


def evidence(discussions: DataFrame, n: int = 3) -> DataFrame:
    """The best n members of each problem: probability (nulls last), unclamped engagement, id."""
    w = Window.partitionBy("problem_id").orderBy(F.desc_nulls_last("p_problem"), F.desc("eng"), "id")
    rows = discussions.where(F.col("problem_id").isNotNull()).withColumn("eng", engagement(False))
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def join_positions(discussions: DataFrame) -> DataFrame:
    """Place of each member in its problem by (observed_at, id), whether it joined, and who created the problem."""
    w = Window.partitionBy("problem_id").orderBy("observed_at", "id")
    rows = discussions.where(F.col("problem_id").isNotNull())
    rows = rows.withColumn("position", F.row_number().over(w)).withColumn("creator_id", F.first("id").over(w))
    return rows.select("problem_id", "id", "position", (F.col("position") > 1).alias("joined"), "creator_id")


def top_terms(discussions: DataFrame, terms: Column, n: int = 10) -> DataFrame:
    """The n most frequent terms of each problem (ties: by name); a member counts a term once."""
    rows = discussions.where(F.col("problem_id").isNotNull()).select("problem_id", "id", F.array_distinct(terms).alias("terms"))
    counts = rows.select("problem_id", F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull()).groupBy("problem_id", "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy("problem_id").orderBy(F.desc("n"), "term")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def platforms(discussions: DataFrame) -> DataFrame:
    """Sorted platforms of each problem, nulls left out."""
    rows = discussions.where(F.col("problem_id").isNotNull())
    return rows.groupBy("problem_id").agg(F.array_sort(F.collect_set("platform")).alias("platforms"))


def admission(discussions: DataFrame) -> DataFrame:
    """Documents and admitted ones by source."""
    out = discussions.groupBy("source_id").agg(F.count("*").alias("docs"), F.count("problem_id").alias("admitted"))
    return out.withColumn("share", F.col("admitted") / F.col("docs"))


def pair_logit(scorer: dict[str, float], same_author: Column | None = None) -> Column:
    """The logit over columns named like the pair features; the cosines enter centred."""
    z = F.lit(scorer["intercept"])
    for name in ("max_member_cosine", "centroid_cosine"):
        if scorer[name]:
            z = z + scorer[name] * (F.col(name) - scorer["cosine_center"])
    for name in ("minhash_jaccard", "title_jaccard", "entity_jaccard", "hours_gap", "same_source", "version_conflict"):
        if scorer[name]:
            z = z + scorer[name] * F.col(name).cast("double")
    return z if same_author is None else z + F.when(same_author, fixed.SAME_AUTHOR_LOGIT).otherwise(0.0)


def probability(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), z))))


def join_probability(rows: DataFrame, scorer: dict[str, float], same_author: Column | None = None) -> DataFrame:
    return rows.withColumn("probability", probability(pair_logit(scorer, same_author))).withColumn("joins", F.col("probability") >= scorer["threshold"])


def cue_features(c: Column) -> Column:
    """log1p of the cue counts, in the fixed order."""
    return F.array(*[F.log1p(cue_count(c, g)) for g in fixed.CUES])


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def softmax(features: Column, weights: list[list[float]], intercepts: list[float], means: list[float], scales: list[float]) -> Column:
    """Class probabilities of a multinomial model over standardized features, the logits taken against their maximum."""

    def logits(f: Column) -> Column:
        return F.array(*[sum((w * (f[i] - m) / s for i, (w, m, s) in enumerate(zip(row, means, scales))), F.lit(b)) for row, b in zip(weights, intercepts)])

    shifted = lambda z: let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))
    shares = lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda x: x / total))
    return let(let(let(features, logits), shifted), shares)


def decided(p: Column, threshold: float = 0.5) -> Column:
    """Struct of p_problem (the first four classes), is_problem, and the likeliest category on the chosen side."""

    def of(p: Column) -> Column:
        side = lambda first, last: F.array_max(F.array(*[F.struct(p[i], F.lit(-i), F.lit(fixed.LABELS[i])) for i in range(first, last)]))["col3"]
        total = p[0] + p[1] + p[2] + p[3]
        return F.struct(total.alias("p_problem"), (total >= threshold).alias("is_problem"), F.when(total >= threshold, side(0, 4)).otherwise(side(4, 6)).alias("category"))

    return let(p, of)


def decision(p: Column, threshold: float, existing: Column, candidate: Column, p_join: Column, join_threshold: float) -> Column:
    """unclassified, not_problem, kept, joined or created."""
    return F.when(p.isNull(), "unclassified").when(p < threshold, "not_problem").when(existing.isNotNull(), "kept").when(candidate.isNotNull() & (p_join >= join_threshold), "joined").otherwise("created")


def assigned(discussions: DataFrame, group: str, scorer: dict[str, float] = fixed.PROBLEM_SCORER, threshold: float = 0.5) -> DataFrame:
    """id, decision, problem_id, probability: classify, then assign, for a fixed candidate rule.

    Of each discussion that is a problem and has none yet, the candidate is the newest one before it in its group; it
    joins that one's problem at the scorer's threshold, else it founds one, named by its id. A chain of joins is a run
    between two foundings, so that one window over the group and its running count assign all: nothing is iterated.
    discussions: id, observed_at, p_problem, existing (a problem or null), unit vector `v`, headline tokens `t`, versions
    `ver`, author_hash and the group, which must be of bounded size (a thread).
    """
    wanted = discussions.where((F.col("p_problem") >= threshold) & F.col("existing").isNull())
    w = Window.partitionBy(group).orderBy("observed_at", "id")
    before = F.lag(F.struct("id", "observed_at", "v", "t", "ver", "author_hash")).over(w)
    met = wanted.withColumn("c", before)
    conflict = (F.size("ver") > 0) & (F.size("c.ver") > 0) & ~F.arrays_overlap("ver", "c.ver")
    met = met.withColumns(
        {
            "max_member_cosine": F.round(F.coalesce(dot(F.col("v"), F.col("c.v")), F.lit(-1.0)), 9),
            "centroid_cosine": F.lit(0.0), "minhash_jaccard": F.lit(0.0), "entity_jaccard": F.lit(0.0), "same_source": F.lit(0),
            "title_jaccard": F.coalesce(jaccard(F.col("t"), F.col("c.t")), F.lit(0.0)),
            "hours_gap": (F.unix_micros("observed_at") - F.unix_micros("c.observed_at")) / F.lit(3.6e9), "version_conflict": conflict.cast("int"),
        }
    )
    same = F.coalesce(F.col("author_hash") == F.col("c.author_hash"), F.lit(False))
    scored = met.withColumn("probability", F.when(F.col("c.id").isNotNull(), probability(pair_logit(scorer, same))))
    joins = F.coalesce(F.col("probability") >= scorer["threshold"], F.lit(False))
    founded = F.last(F.when(~joins, F.col("id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = scored.select("id", F.col("c.id").alias("candidate"), "probability", founded.alias("own"))
    rows = discussions.select("id", "p_problem", "existing").join(found, "id", "left")
    said = decision(F.col("p_problem"), threshold, F.col("existing"), F.col("candidate"), F.col("probability"), scorer["threshold"])
    problem = F.when(said == "kept", F.col("existing")).when(said.isin("joined", "created"), F.col("own"))
    return rows.select("id", said.alias("decision"), problem.alias("problem_id"), "probability")


def sizes(problems: DataFrame) -> DataFrame:
    """How many problems have so many members, and how many of them several voices."""
    return problems.groupBy("member_count").agg(F.count("*").alias("problems"), F.count_if(F.col("voice_count") >= 2).alias("multi_voice"))


def detail(problems: DataFrame, problem_id: int, as_of: Column) -> DataFrame:
    """One problem with its factors, rounded as responses show them; no window and no least number of voices."""
    out = demand(problems.where(F.col("problem_id") == problem_id), as_of)
    factors = [F.round(c, 4).alias(c) for c in ("f_voices", "f_sources", "f_recency", "f_engagement", "f_category", "demand")]
    return out.select("problem_id", "statement", "category", "voice_count", "source_count", *factors)
