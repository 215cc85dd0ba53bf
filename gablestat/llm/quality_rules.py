"""Quality rules as a bitmask ledger.

``ledger`` measures every text once and stores the measurements and one failure bit for each rule.
Policies are versioned sets of rules: applying one is a bitwise test of the stored bits, and
``ablations`` tells what each rule of a policy decides, from counts per distinct bitmask. No text is
read again for either.

Defined results: a null text counts as a text without words; an empty or blank text has no words and
fails ``too_few_words``; repeated rows are judged each for itself; an empty table gives an empty ledger;
columns of the input that bear a name of the ledger are replaced, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Bit of each rule, and its failure as SQL over the measurements; a rule keeps its bit for good.
RULES: dict[str, tuple[int, str]] = {
    "too_few_words": (0, "n_words < 50"),
    "repeated_words": (1, "100 * n_repeat_words > 50 * n_words"),
    "many_symbols": (2, "100 * n_symbols > 30 * n_words"),
    "duplicate_lines": (3, "100 * n_dup_lines > 45 * n_lines"),
    "word_length": (4, "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    "shouting": (5, "100 * n_exclaims > 80 * n_words"),
}

#: Versioned policies: a document stays if none of the named rules failed.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("too_few_words", "repeated_words"),
    "full-1": ("too_few_words", "repeated_words", "many_symbols", "duplicate_lines", "word_length", "shouting"),
}


def mask_of(policy: str) -> int:
    """The bits of a policy's rules."""
    return sum(1 << RULES[name][0] for name in POLICIES[policy])


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``n_words word_chars n_symbols n_exclaims n_lines n_dup_lines n_repeat_words`` (long).

    Repeated words are found inside the row: three-word windows are hashed to 64 bits and sorted with their
    places, neighbours of equal hash are repeats, and the places that they cover are counted once.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_exclaims", "n_lines", "n_dup_lines", "n_repeat_words")
    kept = docs.drop(*names)
    whole = F.coalesce(F.col(text), F.lit(""))
    split = kept.withColumns({
        "_words": F.array_remove(F.split(whole, SPACES), ""),
        "_lines": F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    joined = split.withColumns({"_joined": F.array_join("_words", "")})

    def window(i: Column) -> Column:
        words = F.col("_words")
        return F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))

    sorted_ = joined.withColumns({
        "_runs": F.when(F.size("_words") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_words") - 3), window))),
    })
    runs = F.col("_runs")
    repeated = sorted_.withColumns({
        "_again": F.sort_array(F.transform(
            F.filter(runs, lambda x, j: (x["h"] == F.get(runs, j - 1)["h"]) | (x["h"] == F.get(runs, j + 1)["h"])), lambda x: x["i"])),
    })
    covered = F.aggregate(
        F.col("_again"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    return repeated.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length("_joined").cast("long"),
        "n_symbols": (F.octet_length("_joined") - F.octet_length(_without(F.col("_joined"), SYMBOLS))).cast("long"),
        "n_exclaims": (F.octet_length("_joined") - F.octet_length(_without(F.col("_joined"), "!"))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
    }).drop("_words", "_lines", "_joined", "_runs", "_again")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with their measurements and ``failed_bits`` (long), the bit of every rule that failed."""
    bits = [F.when(F.expr(test), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")) for bit, test in RULES.values()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs.drop("failed_bits"), text).withColumn("failed_bits", total)


def fails(policy: str, bits: str = "failed_bits") -> Column:
    """Whether a stored bitmask breaks a policy."""
    return F.col(bits).bitwiseAND(F.lit(mask_of(policy)).cast("long")) != 0


def ablations(ledger_rows: DataFrame, policy: str, bits: str = "failed_bits") -> DataFrame:
    """What each rule of a policy decides: ``rule failed only_this kept_without``, one row per rule.

    Rows are first counted per distinct bitmask, of which there are few, so nothing but counts is shuffled.
    ``only_this`` counts the rows that no other rule of the policy rejects; ``kept_without`` is what stays
    when the rule is left out. On an empty ledger all counts are 0.
    """
    mask = mask_of(policy)
    counted = ledger_rows.groupBy(F.col(bits).bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    sums = []
    for name in POLICIES[policy]:
        bit = 1 << RULES[name][0]
        own = F.col("bits").bitwiseAND(F.lit(bit).cast("long")) != 0
        rest = F.col("bits").bitwiseAND(F.lit(mask ^ bit).cast("long")) != 0
        sums.append(F.struct(
            F.lit(name).alias("rule"), F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("failed"),
            F.coalesce(F.sum(F.when(own & ~rest, F.col("n"))), F.lit(0)).alias("only_this"),
            F.coalesce(F.sum(F.when(~rest, F.col("n"))), F.lit(0)).alias("kept_without")))
    return counted.agg(F.array(*sums).alias("r")).select(F.inline("r"))
