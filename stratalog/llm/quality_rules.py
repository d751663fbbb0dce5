"""Quality rules as weak supervision.

Each rule looks at a few counts of a document and votes good (1), bad (-1) or
abstains (0).  Instead of asking that every rule passes, the votes are weighed:
expectation-maximisation estimates, for each rule, how often it votes good on
good documents and bad on bad ones, and from these each document's posterior
probability of being good.  A document is kept at `KEEP` or more, unless it
fails a base rule.

All counts are made with DataFrame functions.  The votes are aggregated to one
row per vote pattern, at most 3 ** len(RULES), and EM runs over those on the
driver; its result goes back into the plan as a few literals.

Repeated words come from sorting each text's window hashes with the windows'
places in the low bits, so equal windows are neighbours.  Neighbours whose
hashes meet are compared word for word; a text in which different windows meet
is sorted again by the windows themselves, so the counts are exact.

Defined results: null, empty and wordless texts have counts 0 and fail the
base rules; texts of any length are counted whole; a posterior of exactly
`KEEP` is kept; repeated rows come out once each and count as often in EM; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import drop_rows, materialise

KEEP = 0.5
WINDOW = 3
WINDOW_HASH = "xxhash64(words[i], words[i + 1], words[i + 2])"
#: Characters counted as symbols, and the white space that parts words.
SYMBOLS = "#*$%&|<>"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = "the of and to in is that for it was on with as be by at this are from or der die und den von das mit sich des ist im nicht ein eine als auch le la les de et des en un une du que qui dans pour est sur au par el los las del por con para se su".split()


def text_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and the counts that the rules look at, one row per row."""
    text = F.col(text_col)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(text, F.lit("")).alias("t"))
    rows = rows.withColumn("words", F.filter(F.split("t", SPACE), lambda w: w != ""))
    rows = rows.withColumn("n_words", F.size("words").cast("long")).withColumn("bits", F.length(F.bin("n_words")))
    windows = F.expr(
        f"if(n_words >= {WINDOW}, sort_array(transform(sequence(0, cast(n_words as int) - {WINDOW}),"
        f" i -> shiftleft({WINDOW_HASH}, bits) | cast(i as bigint))), cast(array() as array<bigint>))"
    )
    rows = rows.withColumn("windows", windows)
    # Neighbours with the same hash; what is left of each is its place in the text.
    place = "cast(x & (shiftleft(1L, bits) - 1) as int)"
    before = place.replace("x &", "windows[j - 1] &")
    met = "j > 0 and shiftright(x, bits) = shiftright(windows[j - 1], bits)"
    same = " and ".join(f"words[{place} + {k}] = words[{before} + {k}]" for k in range(WINDOW))
    by_hash = (
        f"sort_array(transform(filter(windows, (x, j) -> ({met})"
        " or (j < size(windows) - 1 and shiftright(x, bits) = shiftright(windows[j + 1], bits))), x -> x & (shiftleft(1L, bits) - 1)))"
    )
    spelt = f"sort_array(transform(sequence(0, size(words) - {WINDOW}), i -> named_struct('s', concat_ws(' ', slice(words, i + 1, {WINDOW})), 'i', cast(i as bigint))))"
    by_words = f"sort_array(transform(filter(transform({spelt}, x -> x), (x, j) -> (j > 0 and x.s = spelt[j - 1].s) or (j < size(spelt) - 1 and x.s = spelt[j + 1].s)), x -> x.i))"
    by_words = f"aggregate(array({spelt}), cast(array() as array<bigint>), (a, spelt) -> {by_words.replace(f'transform({spelt}, x -> x)', 'spelt')})"
    again = F.expr(f"if(exists(filter(transform(windows, (x, j) -> {met} and not ({same})), c -> c), c -> c), {by_words}, {by_hash})")
    rows = rows.withColumn("again", again)
    covered = F.expr(f"aggregate(again, named_struct('last', cast(-{WINDOW} as bigint), 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least({WINDOW}L, p - a.last)), a -> a.n)")
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
    rows = rows.withColumn("lines", lines)
    function_words = F.size(F.filter("words", lambda w: w.isin(FUNCTION_WORDS)))

    def letters_left(without: str) -> Column:
        return F.length("t") - F.length(F.regexp_replace("t", without, ""))

    return rows.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.expr("aggregate(words, 0L, (a, w) -> a + length(w))").alias("word_chars"),
        letters_left("[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        function_words.cast("long").alias("n_function_words"),
        letters_left("[A-Z]+").cast("long").alias("n_capitals"),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """The rules' votes, as columns over `text_counts`."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    length = F.col("word_chars") / n
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    dup, rep = F.col("n_dup_lines") / lines, F.col("n_repeat_words") / n
    symbols, function, capitals = F.col("n_symbols") / n, F.col("n_function_words") / n, F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "long_enough": _vote(F.col("n_words") >= 80, F.col("n_words") < 50),
        "word_length": _vote((length >= 3) & (length <= 9), (length < 2.5) | (length > 12)),
        "few_symbols": _vote(symbols <= 0.05, symbols > 0.2),
        "lines_differ": _vote((F.col("n_lines") > 1) & (dup <= 0.1), dup > 0.3),
        "words_differ": _vote(rep <= 0.15, rep > 0.4),
        "function_words": _vote(function >= 0.1, function < 0.02),
        "few_capitals": _vote(capitals <= 0.15, capitals > 0.4),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list[float], list[float]]:
    """(prior log odds, log ratio of a good vote, log ratio of a bad vote) by EM over (votes, count) rows.

    Abstentions say nothing.  Rates are kept from 0 and 1 by one pseudo-vote
    each way, and no rule may come out worse than chance.
    """
    if not patterns:
        return 0.0, [], []
    k = len(patterns[0][0])
    prior, on_good, on_bad = 0.85, [0.95] * k, [0.5] * k  # P(good vote | good), P(bad vote | bad)

    def ratios() -> tuple[float, list[float], list[float]]:
        return math.log(prior / (1 - prior)), [math.log(g / (1 - b)) for g, b in zip(on_good, on_bad)], [math.log((1 - g) / b) for g, b in zip(on_good, on_bad)]

    for _ in range(rounds):
        base, up, down = ratios()
        total = good_total = 0.0
        good, bad = [[1.0, 1.0] for _ in range(k)], [[1.0, 1.0] for _ in range(k)]  # [agreeing, other]
        for votes, n in patterns:
            odds = base + sum(up[r] if v > 0 else down[r] for r, v in enumerate(votes) if v)
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            total += n
            good_total += n * p
            for r, v in enumerate(votes):
                if v:
                    good[r][v < 0] += n * p
                    bad[r][v > 0] += n * (1 - p)
        prior = min(0.98, max(0.3, (good_total + 1) / (total + 2)))
        for r in range(k):
            g, b = good[r][0] / sum(good[r]), bad[r][0] / sum(bad[r])
            on_good[r] = min(0.9999, max(0.5, g))
            on_bad[r] = min(0.9999, max(1.0001 - on_good[r], b))
    return ratios()


def votes_to_posterior(model: tuple[float, list[float], list[float]], names: list[str]) -> Column:
    """The posterior probability of being good, from the vote columns."""
    base, up, down = model
    odds = F.lit(base)
    for name, u, d in zip(names, up, down):
        odds = odds + F.when(F.col(name) > 0, F.lit(u)).when(F.col(name) < 0, F.lit(d)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def _voted(counts: DataFrame) -> tuple[DataFrame, list[str]]:
    votes = {f"vote_{name}": v for name, v in rules().items()}
    return counts.select("*", *[v.alias(name) for name, v in votes.items()]), list(votes)


def learn(voted: DataFrame, votes: list[str]) -> tuple[float, list[float], list[float]]:
    """EM over the vote patterns of a table, of which there are at most 3 ** len(votes)."""
    patterns = voted.groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).orderBy(*votes).collect()
    return fit([(tuple(r[v] for v in votes), r["n"]) for r in patterns]) if patterns else (0.0, [0.0] * len(votes), [0.0] * len(votes))


def _judged(voted: DataFrame, votes: list[str], model: tuple[float, list[float], list[float]]) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = voted.withColumn("quality", votes_to_posterior(model, votes)).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality for each row."""
    voted, votes = _voted(materialise(text_counts(df, id_col, text_col), "counts"))
    return _judged(voted, votes, learn(voted, votes)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def kept_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that are kept, with all their columns.

    Rejected rows are named by id and hash of the text, so rows that share an
    id are judged each by its own text; the texts themselves are not shuffled
    while the names can be broadcast.
    """
    voted, votes = _voted(materialise(text_counts(df, id_col, text_col), "counts"))
    rejected = _judged(voted, votes, learn(voted, votes)).filter("not kept").select("doc_id", "text_hash")
    return drop_rows(df, rejected, [F.col(id_col).cast("long"), F.xxhash64(F.col(text_col))])
