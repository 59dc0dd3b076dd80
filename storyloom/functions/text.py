"""Text as Column functions: all built-in expressions, so they stay in generated code."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom import fixed


def normalize(c: Column) -> Column:
    """Lower case, right single quote as apostrophe. Compatibility forms: see compatibility()."""
    return F.lower(F.replace(c, F.lit("’"), F.lit("'")))


def compatibility(c: Column) -> Column:
    """Unicode NFKC by an Arrow UDF: Spark has no such function. Apply before normalize() where input isn't composed."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return nfkc(c)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(normalize(c), F.lit(fixed.TOKEN), F.lit(0))


def without(array: Column, words: list[str], longer_than: int = 1) -> Column:
    """The tokens that are longer and not among the words; a list in isin() becomes a hash set, an array would be searched."""
    return F.filter(array, lambda t: (F.length(t) > longer_than) & ~t.isin(words))


def content_tokens(c: Column) -> Column:
    return without(tokens(c), fixed.STOPWORDS)


def shingles(array: Column, size: int = 3) -> Column:
    """Distinct windows of `size` tokens; the distinct tokens where there are fewer. Windows come from zipped slices,
    which keeps the tokenizer out of a lambda's body."""
    n = F.size(array) - (size - 1)
    out = F.slice(array, F.lit(1), F.greatest(n, F.lit(0)))
    for k in range(2, size + 1):
        out = F.zip_with(out, F.slice(array, F.lit(k), F.greatest(n, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(n < 1, array).otherwise(out))


def exploded(df: DataFrame, array: str, alias: str) -> DataFrame:
    """explode() without the filter on the array that the optimizer would infer and run the array's expression twice for."""
    return df.withColumn(alias, F.explode_outer(array)).where(F.col(alias).isNotNull()).drop(array)


def version_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(normalize(c), F.lit(fixed.VERSION), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda v: F.regexp_replace(v, "^v", ""))))


def headline_tokens(c: Column) -> Column:
    """Content tokens of a headline without template prefix and boilerplate words."""
    bare = F.regexp_replace(c, fixed.TEMPLATE_PREFIX, " ")
    return F.array_sort(F.array_distinct(without(tokens(bare), fixed.STOPWORDS + fixed.BOILERPLATE)))


def problem_version_tokens(c: Column) -> Column:
    named = F.transform(F.regexp_extract_all(c, F.lit("(?i)" + fixed.NAMED_VERSION), F.lit(0)), F.lower)
    named = F.filter(named, lambda v: ~v.rlike(fixed.NOT_A_VERSION))
    return F.array_sort(F.array_union(version_tokens(c), named))


def cue_count(c: Column, group: str) -> Column:
    return F.regexp_count(c, F.lit("(?i)" + fixed.CUES[group]))


def rule_label(c: Column) -> Column:
    """The first cue group that fires; praise or chat alone is no problem."""
    fires = {g: cue_count(c, g) > 0 for g in fixed.CUES}
    out = F.when(fires["praise_or_chat"] & ~(fires["bug"] | fires["missing"]), fixed.LABELS[5])
    for group, label in zip(("bug", "cost_perf", "missing", "friction", "how_to"), fixed.LABELS):
        out = out.when(fires[group], label)
    return out.otherwise(fixed.LABELS[5])


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[ \\t\\n\\r\\f]+", " "))


def excerpt(c: Column, limit: int = 280) -> Column:
    """White space collapsed; beyond the limit cut before it, without the last partial word, with an ellipsis."""
    x = collapse(c)
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.regexp_replace(F.left(x, F.lit(limit - 1)), " [^ ]*$", ""), F.lit("…")))


def fold_plural(token: Column) -> Column:
    plural = (F.length(token) > 3) & token.endswith("s") & ~token.endswith("ss")
    return F.when(plural, F.left(token, F.length(token) - 1)).otherwise(token)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def strip_tags(c: Column) -> Column:
    """Tags become spaces, then the five common entities are unescaped, then white space is collapsed."""
    out = F.regexp_replace(c, "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


def opening_text(title: Column, body: Column) -> Column:
    return F.when(F.length(F.coalesce(body, F.lit(""))) == 0, title).otherwise(F.concat(title, F.lit(". "), body))


def long_enough(c: Column, least: int = 80) -> Column:
    return F.length(c) >= least


def map_tokens(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit(fixed.MAP_WORD), F.lit(0))
    return F.array_distinct(without(F.transform(words, lambda w: F.regexp_replace(w, "^[.-]+|[.-]+$", "")), fixed.MAP_STOPWORDS, 2))


#: Frequent function words by language: enough to tell these four apart.
PROFILES = {"de": "der die und den das von mit ist nicht ein", "en": "the of and to in is that for was on", "es": "de la que el en los del las por con", "fr": "le la les des et une est du dans pour"}


def detect_language(c: Column, declared: Column | None = None, least: int = 60) -> Column:
    """The language with the most function words; a short text has the declared code, `und` without one."""
    words = F.split(F.lower(collapse(c)), " ")

    def hits(profile: str) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(profile.split())))

    scores = [F.struct(hits(p).alias("n"), F.lit(lang).alias("lang")) for lang, p in PROFILES.items()]
    best = F.sort_array(F.array(*scores), asc=False)[0]
    code = F.when(declared.rlike("^[a-zA-Z]{2,3}$"), F.lower(declared)) if declared is not None else F.lit(None)
    return F.when((F.length(c) >= least) & (best["n"] > 0), best["lang"]).otherwise(F.coalesce(code, F.lit("und")))


def gazetteer(c: Column, entities: list[tuple[str, list[str], bool]]) -> Column:
    """Sorted ids of the entities named in a text. entities: id, aliases, whether case matters.

    One pattern for each case rule, the longest alias first, bounded by no letter or digit.
    """
    out = F.array().cast("array<string>")
    for exact in (False, True):
        names = {(a if exact else a.lower()): i for i, aliases, case in entities if case == exact for a in aliases}
        if not names:
            continue
        quoted = "|".join(r"\Q" + a + r"\E" for a in sorted(names, key=lambda a: (-len(a), a)))
        found = F.regexp_extract_all(c, F.lit(("" if exact else "(?i)") + f"(?<![A-Za-z0-9])(?:{quoted})(?![A-Za-z0-9])"), F.lit(0))
        ids = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        out = F.array_union(out, F.transform(found, lambda a: F.element_at(ids, a if exact else F.lower(a))))
    return F.array_sort(F.array_distinct(out))


def parsed_query(c: Column) -> Column:
    """Struct of text (256 characters, collapsed), tokens, versions and recency intent."""
    text = collapse(normalize(F.left(c, F.lit(256))))
    return F.struct(text.alias("text"), content_tokens(text).alias("tokens"), version_tokens(text).alias("versions"), text.rlike(fixed.RECENCY).alias("recency"))


def relative_time(later: Column, earlier: Column) -> Column:
    """now, minutes, hours or days ago, as cards show it."""
    minutes = F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 60)
    out = F.when(minutes < 1, F.lit("now")).when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
    return out.when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))


def initials(name: Column) -> Column:
    words = F.filter(F.split(F.trim(name), r"[\s._-]+"), lambda w: F.length(w) > 0)
    return F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.left(w, F.lit(1))), ""))


def echoes(excerpt_: Column, statement: Column) -> Column:
    """Whether an excerpt begins with the first 60 characters of the statement, letters and digits alone."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    first = F.left(bare(statement), F.lit(60))
    return (F.length(first) > 0) & F.startswith(bare(excerpt_), first)
