"""Text predicates and scores as column expressions (no Python in the data path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word lists and cue phrases that decide results.
PROMPT_STOP_WORDS = (
    "the is of and a to in that it for was on are with what when where who how i you me my we our so be do did does get got "
    "very too now this that these those some many each every other more gonna wanna"
).split()
SEARCH_STOP_WORDS = (
    "the and for you that this with from have are was were will would could should about also just like then than over into only "
    "more some such each every other many most its our his her they them these those not but can all been had has did does get got "
    "very too now how"
).split()
REFERENTIAL_WORDS = (
    "my our mine ours we us this that these those the it they them their previous last before yesterday earlier again still same"
).split()
CONSTRAINT_CUES = (
    "don't touch", "do not touch", "dont touch", "never change", "never touch", "must stay", "must not change", "must never",
    "do not edit", "don't edit", "keep it as is", "keep as is", "leave it alone", "hands off", "do not modify", "don't modify",
    "never modify", "off limits",
)
DECISION_CUES = (
    "decided to", "decided against", "we decided", "i decided", "decision:", "going with", "we'll go with", "going to use", "chose ",
    "chosen ", "opted for", "opted to", "settled on", "instead of", "rather than", "switched to", "switching to", "will use",
    "we'll use", "let's use", "standardize on", "standardise on",
)
ERROR_CUES = ("error", "exception", "traceback", "failed", "failing", "broken", "bug", "crash")
FIX_CUES = ("fixed", "resolved", "solved", "the fix", "turned out", "root cause", "now works", "works now", "was because")
BUCKET_CUES = {
    "software": ("code", "python", "javascript", "bug", "error", "function", "api", "server", "docker", "git", "database", "sql", "install", "compile"),
    "stem": ("equation", "physics", "chemistry", "calculus", "theorem", "molecule", "biology", "integral", "proof", "algebra"),
    "business": ("marketing", "startup", "invoice", "salary", "customer", "revenue", "business", "client", "resume", "interview", "stock", "tax"),
    "creative": ("story", "character", "novel", "poem", "song", "roleplay", "fantasy", "chapter", "plot", "lyrics", "art", "game design"),
    "admin": ("schedule", "calendar", "email", "meeting", "checklist", "plan my", "organise", "organize", "reminder", "todo"),
    "health": ("workout", "diet", "calories", "symptom", "sleep", "doctor", "recipe", "travel", "exercise", "medication"),
    "social": ("girlfriend", "boyfriend", "friend", "relationship", "family", "coworker", "argument", "date", "apologize"),
    "world": ("election", "war", "history", "country", "president", "economy", "news", "culture", "government", "climate"),
    "meta": ("you said", "your memory", "as an ai", "chatgpt", "claude", "your training", "previous conversation", "remember when"),
}


# What a figure with its unit and what an identifier looks like.
FIGURE = r"(?i)\b\d+(?:[.,:]\d+)*[ \t\n\r\f]?(?:%|km|kg|mb|gb|ms|min|h|am|pm|usd|eur|inr|\$|€|₹|[kmb]\b|s\b)?"
IDENTIFIER = r"\b(?:[a-z0-9]+_[a-z0-9_]+|[a-z]+[A-Z][A-Za-z0-9]+|[A-Za-z_][\w-]*\.[a-z]{1,4}|[A-Z]{2,}[0-9]*)\b"


def words(text: Column) -> Column:
    """White-space separated words; an empty text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


def letters(text: Column) -> Column:
    """Lower-case runs of letters, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")


def search_terms(text: Column, most: int = 30) -> Column:
    """What a prompt is searched by: its first ``most`` words of three letters or more, without stop words."""
    first = F.slice(F.filter(letters(text), lambda w: F.length(w) > 2), 1, most)
    return F.array_except(first, F.array(*map(F.lit, SEARCH_STOP_WORDS)))


def token_estimate(text: Column) -> Column:
    """The deterministic ruler: a quarter of the characters."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def code_token_estimate(text: Column) -> Column:
    """The ruler for code: the larger of a quarter and a third."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.greatest(F.floor(n / 4), F.floor(n / 3)).cast("long")


def prompt_keywords(text: Column) -> Column:
    """Sorted distinct lower-case words without punctuation and stop words."""
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_\s]", " "))
    return F.array_sort(F.array_except(F.array_distinct(words(plain)), F.array(*map(F.lit, PROMPT_STOP_WORDS))))


def contains_any(text: Column, cues) -> Column:
    found = F.lit(False)
    for cue in cues:
        found = found | F.contains(text, F.lit(cue))
    return found


def cue_hits(text: Column, cues) -> Column:
    return sum((F.contains(text, F.lit(c)).cast("int") for c in cues), F.lit(0))


def strip_code(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)```.*?```", " ")


def decision_cue(text: Column) -> Column:
    """constraint, incident (an error and a fix), decision or null, in that order; code blocks don't count."""
    low = F.lower(strip_code(text))
    return (
        F.when(contains_any(low, CONSTRAINT_CUES), F.lit("constraint"))
        .when(contains_any(low, ERROR_CUES) & contains_any(low, FIX_CUES), F.lit("incident"))
        .when(contains_any(low, DECISION_CUES), F.lit("decision"))
    )


def coarse_bucket(text: Column) -> Column:
    """The bucket with most cues; the first of equals; general without any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    name, most = F.lit("general"), F.lit(0)
    for bucket, cues in BUCKET_CUES.items():
        hits = cue_hits(low, cues)
        name, most = F.when(hits > most, F.lit(bucket)).otherwise(name), F.greatest(most, hits)
    return name


def normalised_hash(text: Column, size: int = 20) -> Column:
    """First characters of the sha256 of the text with white space and case folded."""
    return F.substr(F.sha2(F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+", " "))), 256), F.lit(1), F.lit(size))


def idempotency_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def plain_ascii(text: Column) -> Column:
    """Other characters become spaces, so that word borders mean the same to every engine."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", " ")


def units_ascii(text: Column) -> Column:
    """As ``plain_ascii``, but signs of currency stay."""
    return F.regexp_replace(text, r"[^\x00-\x7F€₹]", " ")


def figures(text: Column) -> Column:
    """Distinct figures with their units, of more than one character, at most 15, in order."""
    return _figures(units_ascii(text))


def _figures(plain: Column) -> Column:
    found = F.transform(F.regexp_extract_all(plain, F.lit(FIGURE), F.lit(0)), lambda x: F.trim(x))
    return F.slice(F.array_distinct(F.filter(found, lambda x: F.length(x) > 1)), 1, 15)


def identifiers(text: Column) -> Column:
    """Distinct snake_case, camelCase, file.ext and capital identifiers, at most 15, in order."""
    return _identifiers(plain_ascii(text))


def _identifiers(plain: Column) -> Column:
    found = F.regexp_extract_all(plain, F.lit(IDENTIFIER), F.lit(0))
    return F.slice(F.array_distinct(found), 1, 15)


def entities(text: Column) -> Column:
    """The fallback entity finder: distinct capitalised words of three letters or more, at most 25, in order."""
    return _entities(plain_ascii(text))


def _entities(plain: Column) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"\b([A-Z][a-zA-Z]{2,})\b"), F.lit(1))), 1, 25)


def with_density(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with n_words, code and density: facts per token: entities .45, figures and identifiers .25, code .20, type-token ratio of 300 words .10.

    What several parts need (words, plain text, counts) is projected once, so no scan of a text is repeated.
    """
    text = F.col(text_col)
    read = rows.withColumns({"__words": words(text), "__plain": plain_ascii(text), "__units": units_ascii(text), "code": F.contains(text, F.lit("```"))})
    counted = read.withColumns({
        "n_words": F.size("__words").cast("long"), "__window": F.array_distinct(F.transform(F.slice("__words", 1, 300), lambda w: F.lower(w))),
        "__named": F.size(_entities(F.col("__plain"))), "__exact": F.size(_figures(F.col("__units"))) + F.size(_identifiers(F.col("__plain"))),
    })
    per100 = F.greatest(F.col("n_words"), F.lit(1)) / F.lit(100.0)
    share = lambda n: F.least(F.lit(1.0), F.col(n) / per100 / 6)
    varied = F.size("__window") / F.greatest(F.least(F.col("n_words"), F.lit(300)), F.lit(1))
    score = 0.45 * share("__named") + 0.25 * share("__exact") + 0.2 * F.col("code").cast("double") + 0.1 * varied
    return counted.withColumn("density", F.round(F.least(F.lit(1.0), score), 4)).drop("__words", "__plain", "__units", "__window", "__named", "__exact")


def representation(n_words: Column, score: Column, code: Column, creative: Column, document: Column, keep: int, lossless: float) -> Column:
    """How a turn is stored: document, short, code, creative_continuity, dense_long or diffuse_long."""
    return (
        F.when(document, "document").when(n_words <= keep, "short").when(code, "code").when(creative, "creative_continuity")
        .when(score >= lossless, "dense_long").otherwise("diffuse_long")
    )


def summary_coverage(summary: Column, terms: Column) -> Column:
    """Share of the must-have terms that a summary holds, whatever their case; 1 without terms."""
    low = F.lower(F.coalesce(summary, F.lit("")))
    hits = F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t))))
    return F.when(F.size(terms) == 0, F.lit(1.0)).otherwise(F.round(hits / F.size(terms), 4))


def is_degenerate(text: Column) -> Column:
    """Too short, too much outside ASCII, a giant word, a word four times in a row, or too few distinct words."""
    split = words(text)
    odd = F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")) / F.greatest(F.length(text), F.lit(1))
    run = F.aggregate(
        split, F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("most")),
        lambda a, w: F.struct(
            w.alias("w"), F.when(a["w"] == w, a["n"] + 1).otherwise(1).alias("n"),
            F.greatest(a["most"], F.when(a["w"] == w, a["n"] + 1).otherwise(1)).alias("most"),
        ),
    )["most"]
    return (
        (F.length(F.coalesce(text, F.lit(""))) < 40) | (odd > 0.08)
        | (F.coalesce(F.array_max(F.transform(split, lambda w: F.length(w))), F.lit(0)) > 60)
        | ((F.size(split) >= 12) & ((run >= 4) | (F.size(F.array_distinct(split)) / F.size(split) < 0.35)))
    )


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def first_json(text: Column) -> Column:
    """The first JSON object of a model's answer, fences stripped; null when there is none that parses."""
    bare = F.regexp_replace(text, r"(?m)^```[a-z]*\s*$", "")
    return F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("")))


def truncate_words(text: Column, n: int) -> Column:
    """At most n words, cut at the last sentence end if that lies past 60 %."""
    kept = F.array_join(F.slice(words(text), 1, n), " ")
    whole = F.regexp_extract(kept, r"(?s)^(.*[.!?])", 1)
    return F.when(F.size(words(text)) <= n, text).when(F.length(whole) > 0.6 * F.length(kept), whole).otherwise(kept)


def contains_word(prompt: Column, vocabulary) -> Column:
    return F.arrays_overlap(words(F.lower(prompt)), F.array(*map(F.lit, vocabulary)))
