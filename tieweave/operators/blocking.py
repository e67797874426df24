"""Candidate pairs of person names by several keys at once, verified by name similarity.

Mentions that agree in surname, forenames and birth year are one form, so a name that a
third of all mentions bear is one row here, and pairs are made between different forms
only; ``members`` says which mentions a form stands for. A form has three kinds of keys:

- ``year``: the sound of its surname and its birth year,
- ``initial``: the sound of its surname and the initial of its first forename,
- ``edit``: hashes of its name and of all that one deletion makes of it.

Two forms meet at every key they share, but the pair is made at the least of them alone,
so nothing has to be made different afterwards. All is column expressions. A key's pairs
grow with the square of the different forms at it, never with its mentions.

Null and empty names have no surname, are no forms and meet nothing. A form without a
birth year has no ``year`` key, one without forenames no ``initial`` key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

SURNAME_SIMILARITY, FORENAME_SIMILARITY = 0.85, 0.8
KINDS = ("year", "initial", "edit")
#: Bits of a key's hash that are joined on; the kind stands above them.
HASH_BITS = 61
# Letters with marks and the plain ones that they stand for.
MARKED, UNMARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy"
# Spellings of one sound, replaced in this order.
SOUNDS = (
    ("^[kgp]n", "n"), ("^wr", "r"), ("^x", "s"), ("^wh", "w"), ("mb$", "m"), ("ght", "t"), ("gh", "g"), ("ph", "f"),
    ("s?ch|tch|sh", "x"), ("dg([eiy])", "j$1"), ("g([eiy])", "j$1"), ("c([eiy])", "s$1"), ("[cq]", "k"), ("[dt]h?", "t"),
    ("v", "f"), ("z", "s"), ("g", "k"), ("b", "p"),
)
#: Consonants that the sounds above leave; doubled ones count once.
CONSONANTS = "fjklmnprstx"


def plain(name: Column) -> Column:
    """Letters a to z of ``name`` alone, marks taken off."""
    return F.regexp_replace(F.translate(F.lower(name), MARKED, UNMARKED), "[^a-z]", "")


def sound(name: Column) -> Column:
    """A phonetic key: the consonants in order by their sound; a vowel at the beginning is ``a``."""
    found = plain(name)
    for pattern, by in (*SOUNDS, *((f"{c}+", c) for c in CONSONANTS)):
        found = F.regexp_replace(found, pattern, by)
    return F.concat(F.regexp_replace(F.substring(found, 1, 1), "[aeiouy]", "a"), F.regexp_replace(F.substring(found, 2, 1000), "[aeiouyhw]", ""))


def deletions(word: Column) -> Column:
    """``word`` and what is left of it without any one character."""
    places = F.sequence(F.lit(1), F.length(word) + 1)  # the last place takes nothing away
    return F.array_distinct(F.transform(places, lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, F.length(word)))))


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity: each character of ``a`` takes the first free equal one of ``b`` within reach."""
    n, m = F.length(a), F.length(b)
    reach = F.greatest(F.floor(F.greatest(n, m) / 2).cast("int") - 1, F.lit(0))
    taken = F.lit("\0")

    def take(state: Column, i: Column) -> Column:
        letter, first = F.substr(a, i, F.lit(1)), F.greatest(i - reach, F.lit(1))
        window = F.substr(state["rest"], first, i + reach - first + 1)
        at = F.instr(window, letter)
        rest = F.overlay(state["rest"], taken, first + at - 1, F.lit(1))
        return F.when(at > 0, F.struct(rest.alias("rest"), F.concat(state["got"], letter).alias("got"))).otherwise(state)

    start = F.struct(b.alias("rest"), F.lit("").alias("got"))
    walk = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    end = F.aggregate(walk, start, take)

    def similarity(state: Column) -> Column:
        got = F.length(state["got"])
        where = F.filter(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda i: F.substr(state["rest"], i, F.lit(1)) == taken)
        moved = F.size(F.filter(where, lambda i: F.substr(b, i, F.lit(1)) != F.substr(state["got"], F.array_position(where, i).cast("int"), F.lit(1))))
        swaps = F.floor(moved / 2)
        return F.when(got == 0, 0.0).otherwise((got / n + got / m + (got - swaps) / got) / 3)

    # One pass binds what the walk has found, so that it isn't walked again for each use.
    return F.when(a == b, 1.0).otherwise(F.transform(F.array(end), similarity)[0])


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro similarity, raised by a tenth of what it lacks for each equal character at the beginning (four at most), from above 0.7."""
    both = F.array(*(F.substring(a, 1, k) == F.substring(b, 1, k) for k in range(1, 5)))
    fits = F.array(*((F.length(a) >= k) & (F.length(b) >= k) for k in range(1, 5)))
    prefix = F.size(F.filter(F.zip_with(both, fits, lambda x, y: x & y), lambda x: x))
    return F.transform(F.array(jaro(a, b)), lambda j: F.when(j > 0.7, j + 0.1 * prefix * (1 - j)).otherwise(j))[0]


def members(mentions: DataFrame) -> DataFrame:
    """(mention_id, form_id, surname, forenames, birth_year) of mentions with a surname. mentions: (mention_id, raw_name, birth_year)."""
    last, first = text.match_name(F.translate(F.lower("raw_name"), MARKED, UNMARKED))
    named = mentions.select("mention_id", plain(last).alias("surname"), F.array_join(F.filter(F.transform(first, plain), lambda w: w != ""), " ").alias("forenames"), "birth_year")
    form = F.md5(F.concat_ws("|", "surname", "forenames", F.coalesce("birth_year", F.lit(""))))
    return named.where("surname != ''").select("mention_id", form.alias("form_id"), "surname", "forenames", "birth_year")


def forms(member: DataFrame) -> DataFrame:
    """(form_id, surname, forenames, birth_year, n_mentions, keys): one row for each form, its keys sorted."""
    own = member.groupBy("form_id", "surname", "forenames", "birth_year").agg(F.count("*").alias("n_mentions"))
    key = lambda kind, value: F.struct(F.lit(KINDS.index(kind)).cast("byte").alias("kind"), F.xxhash64(F.lit(kind), *value).alias("key"))
    heard = sound(F.col("surname"))
    edits = F.transform(deletions(F.concat_ws(" ", "forenames", "surname")), lambda w: key("edit", [w]))
    keys = F.concat(
        F.when(F.col("birth_year").isNull(), F.array()).otherwise(F.array(key("year", [heard, F.col("birth_year")]))),
        F.when(F.col("forenames") == "", F.array()).otherwise(F.array(key("initial", [heard, F.substring("forenames", 1, 1)]))),
        edits,
    )
    return own.withColumn("keys", F.array_sort(keys))


def _packed(key: Column) -> Column:
    """A key as one long: its kind above the lower bits of its hash, so that keys are in the order of kinds."""
    return F.shiftleft(key["kind"].cast("long"), HASH_BITS).bitwiseOR(key["key"].bitwiseAND(F.lit((1 << HASH_BITS) - 1)))


def candidates(form: DataFrame, dated: bool = False) -> DataFrame:
    """(a, b, met_by) and both sides' names and years, of all pairs of forms that share a key, each once.

    With ``dated`` pairs whose years differ are left out, and that is asked first: keys are only compared of the others.

    A form is one row for each of its keys here, many times what the optimizer takes it for, so the join is
    told to shuffle; a side that was broadcast would be on the driver as a whole.
    """
    own = form.withColumn("keys", F.array_sort(F.transform("keys", _packed)))
    side = lambda x: own.select(F.explode("keys").alias("k"), *(F.col(c).alias(x if c == "form_id" else f"{c}_{x}") for c in ("form_id", "surname", "forenames", "birth_year", "keys")))
    shared = F.array_intersect("keys_a", "keys_b")
    first = F.col("a") < F.col("b")
    if dated:
        first &= F.coalesce(F.col("birth_year_a") == F.col("birth_year_b"), F.lit(True))
    met = side("a").hint("merge").join(side("b"), "k").where(first).withColumn("shared", shared).where(F.col("k") == F.col("shared")[0])
    kinds = F.array_distinct(F.transform("shared", lambda x: F.shiftright(x, HASH_BITS)))
    named = F.transform(F.array_sort(kinds), lambda x: F.element_at(F.array(*map(F.lit, KINDS)), (x + 1).cast("int")))
    return met.withColumn("met_by", F.array_join(named, ",")).drop("k", "keys_a", "keys_b", "shared")


def verified(pairs: DataFrame) -> DataFrame:
    """``pairs`` of ``candidates`` whose names are alike and whose years don't differ, with both similarities.

    If one side has no forenames, both need the same birth year, and the similarity of forenames is null.
    """
    apart = F.col("birth_year_a") != F.col("birth_year_b")
    unnamed = (F.col("forenames_a") == "") | (F.col("forenames_b") == "")
    near = pairs.where(~F.coalesce(apart, F.lit(False))).withColumns({
        "surname_similarity": F.round(jaro_winkler(F.col("surname_a"), F.col("surname_b")), 6),
        "forename_similarity": F.when(~unnamed, F.round(jaro_winkler(F.col("forenames_a"), F.col("forenames_b")), 6)),
    })
    fits = F.coalesce(F.col("forename_similarity") >= FORENAME_SIMILARITY, F.col("birth_year_a") == F.col("birth_year_b"), F.lit(False))
    return near.where((F.col("surname_similarity") >= SURNAME_SIMILARITY) & fits)


def recall(truth: DataFrame, member: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, n_true, n_found, recall) of the true pairs of different forms, by each kind of key and by any.

    truth: (left_id, right_id) of mentions; found: (a, b, met_by).
    """
    at = lambda c: member.select(F.col("mention_id").alias(f"{c}_id"), F.col("form_id").alias(f"{c}_form"))
    both = truth.join(at("left"), "left_id").join(at("right"), "right_id").where("left_form != right_form")
    ends = both.select(F.least("left_form", "right_form").alias("a"), F.greatest("left_form", "right_form").alias("b"))
    kinds = F.concat(F.split(F.coalesce("met_by", F.lit("")), ","), F.array(F.when(F.col("met_by").isNotNull(), "any").otherwise("")))
    met = ends.join(found.select("a", "b", "met_by"), ["a", "b"], "left").select(kinds.alias("kinds"))
    counts = met.agg(F.count("*").alias("n_true"), *(F.count_if(F.array_contains("kinds", k)).alias(k) for k in (*KINDS, "any")))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n_found")) for k in (*KINDS, "any"))))
    return counts.select("n_true", each.alias("x")).select("x.kind", "n_true", "x.n_found", F.round(F.col("x.n_found") / F.col("n_true"), 6).alias("recall"))
