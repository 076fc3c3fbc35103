"""Text keys (I01, I02, I03, I27): folding, squashing, tokens, word markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and their plain letters (fixed values; lower case only, applied after lower()).
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(x: Column | str) -> Column:
    """Lower case without accents, blanks collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(_col(x)), MARKED, PLAIN), r"\s+", " "))


def squash(x: Column | str) -> Column:
    """The folded text without anything but a-z and 0-9: for identifiers written with other separators."""
    return F.regexp_replace(fold(x), "[^a-z0-9]", "")


def tokens(x: Column | str) -> Column:
    """Words of the folded text, cut at everything but a-z and 0-9."""
    return F.filter(F.split(fold(x), "[^a-z0-9]+"), lambda w: w != "")


def name_key(x: Column | str, keep: int = 3) -> Column:
    """The first words of a name that are not legal forms: what two spellings of a party have in common."""
    forms = F.array(*[F.lit(f) for f in LEGAL_FORMS])
    words = F.filter(tokens(x), lambda w: ~F.array_contains(forms, w))
    return F.array_join(F.slice(words, 1, keep), " ")


#: Words that only say what kind of company it is (fixed values).
LEGAL_FORMS = ("ltd", "limited", "inc", "llc", "plc", "gmbh", "ag", "sa", "sl", "lda", "unipessoal", "sarl", "srl", "bv", "nv", "co", "corp", "the")


def contains_all(text: Column | str, words: list[str]) -> Column:
    """Whether the folded text contains each of the words."""
    folded = fold(text)
    out = F.lit(True)
    for w in words:
        out = out & folded.contains(w.lower())
    return out


def best_marker(text: Column | str, markers: dict[str, list[str]], at_least: int = 1) -> Column:
    """The label with the most distinct marker words in the text; null below ``at_least`` or on a tie."""

    def judged(have: Column) -> Column:
        scored = F.array(*[F.struct(F.size(F.array_intersect(have, F.array(*[F.lit(w) for w in sorted(ws)]))).alias("n"), F.lit(k).alias("label")) for k, ws in sorted(markers.items())])

        def top(s: Column) -> Column:
            most = F.array_max(F.transform(s, lambda x: x["n"]))
            winners = F.filter(s, lambda x: x["n"] == most)
            return F.when((most >= at_least) & (F.size(winners) == 1), winners[0]["label"])

        return F.transform(F.array(scored), top)[0]

    # a lambda's argument is evaluated once
    return F.transform(F.array(F.array_distinct(tokens(text))), judged)[0]


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / longer length: 1 for equal, 0 for nothing in common; null texts give null."""
    a, b = _col(a), _col(b)
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b).cast("double") / longer.cast("double"))


def name_similarity(a: Column | str, b: Column | str) -> Column:
    """How alike two folded names are, with floors for the ways a bank shortens names.

    Equal 1.0; equal without spaces 0.98; one contains the other 0.85 + 0.14 * covered share; one is the cut-off
    start of the other 0.80 + 0.15 * covered share; else their edit similarity.
    """
    a, b = _col(a), _col(b)
    plain = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    shorter, longer = F.least(F.char_length(a), F.char_length(b)), F.greatest(F.char_length(a), F.char_length(b))
    covered = shorter.cast("double") / longer.cast("double")
    within = lambda x, y: F.concat(F.lit(" "), y, F.lit(" ")).contains(F.concat(F.lit(" "), x, F.lit(" ")))
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(plain(a) == plain(b), F.lit(0.98))
        .when(within(a, b) | within(b, a), 0.85 + 0.14 * covered)
        .when(a.startswith(b) | b.startswith(a), 0.80 + 0.15 * covered)
        .otherwise(edit_similarity(a, b))
    )
