"""Column functions: text operators, paths and bit ranges, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"[\p{L}\p{N}_]"


def strip_comments(text: Column) -> Column:
    """Line and block comments, left to right, not aware of strings; an unterminated block runs to the end."""
    return F.regexp_replace(text, r"//[^\n]*|(?s:/\*.*?(?:\*/|\z))", "")


def strip_line_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"//[^\n]*", "")


def word_pattern(name: Column) -> Column:
    """Regex that finds a literal name between characters that are no word characters, whatever the case."""
    return F.concat(F.lit(rf"(?iu)(?<!{_WORD})\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(rf"\E(?!{_WORD})"))


def has_word(text: Column, name: Column) -> Column:
    return (F.length(name) > 0) & F.rlike(text, word_pattern(name))


def bloom_ladder(text: Column, a: Column, b: Column) -> Column:
    """How a text connects two names: same-net, assign, assign-one-sided, word, word-partial or miss."""
    clean = strip_line_comments(text)
    a, b = F.trim(a), F.trim(b)
    driven = lambda s: F.lower(s).contains("assign") | s.contains("<=")
    both = F.exists(F.split(clean, ";"), lambda s: driven(s) & has_word(s, a) & has_word(s, b))
    # The keyword lies wholly within the 96 characters before the name.
    near = lambda n: F.rlike(clean, F.concat(F.lit(r"(?is)(?:assign.{0,90}|<=.{0,94})"), word_pattern(n)))
    return (
        F.when((a == "") | (b == ""), "miss").when(a == b, "same-net").when(both, "assign").when(near(a) | near(b), "assign-one-sided")
        .when(has_word(clean, a) & has_word(clean, b), "word").when(has_word(clean, a) | has_word(clean, b), "word-partial").otherwise("miss")
    )


def segments(path: Column) -> Column:
    return F.split(path, r"\.")


def prefixes(path: Column) -> Column:
    """All prefixes of a dotted path, shortest first, itself included."""
    s = segments(path)
    return F.transform(F.sequence(F.lit(1), F.size(s)), lambda n: F.array_join(F.slice(s, 1, n), "."))


def strip_selects(path: Column) -> Column:
    return F.regexp_replace(path, r"\[[^\]]*\]", "")


def common_ancestor(a: Column, b: Column) -> Column:
    """Longest common prefix of two dotted paths, by segments; empty if there is none."""
    x, y = segments(a), segments(b)
    same = F.aggregate(
        F.sequence(F.lit(1), F.least(F.size(x), F.size(y))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, i: F.struct(F.when(s["on"] & (F.get(x, i - 1) == F.get(y, i - 1)), s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & (F.get(x, i - 1) == F.get(y, i - 1))).alias("on")),
    )["n"]
    return F.array_join(F.slice(x, 1, same), ".")


def tree_distance(a: Column, b: Column) -> Column:
    shared = F.size(F.filter(segments(common_ancestor(a, b)), lambda s: s != ""))
    return F.size(segments(a)) + F.size(segments(b)) - 2 * shared


def below(path: Column, root: Column) -> Column:
    return (root == "") | (path == root) | path.startswith(F.concat(root, F.lit(".")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def bit_range(select: Column) -> Column:
    """hi and lo (inclusive) of ``[n]``, ``[a:b]``, ``n`` or ``a:b``; null for anything else."""
    inner = F.regexp_extract(select, r"^\s*\[?\s*(-?\d+(?:\s*:\s*-?\d+)?)\s*\]?\s*$", 1)
    number = lambda s: F.trim(s).try_cast("int")
    ends = let(inner, lambda t: F.when(t != "", F.transform(F.split(t, ":"), lambda s: number(s))))
    return let(ends, lambda e: F.when(e.isNotNull(), F.struct(F.array_max(e).alias("hi"), F.array_min(e).alias("lo"))))


def slice_level(a: Column, b: Column, *, allow_base: bool = True) -> Column:
    """Level at which two selects (null: the whole net) may pair: slice_identity, base, select_approx; null if they may not."""
    base = F.lit("base") if allow_base else F.lit(None).cast("string")

    def level(r: Column) -> Column:
        x, y = r["x"], r["y"]
        overlap = (x["lo"] <= y["hi"]) & (y["lo"] <= x["hi"])
        return F.when(x.isNull() | y.isNull(), "select_approx").when(x == y, "slice_identity").when(overlap, "base").otherwise(base)

    ranges = let(F.struct(bit_range(a).alias("x"), bit_range(b).alias("y")), level)
    return F.when(a.isNull() & b.isNull(), "base").when(a.isNull() | b.isNull(), base).otherwise(ranges)


def expand_names(path: Column, env: Mapping[str, Column]) -> Column:
    """``${NAME}``, ``$(NAME)`` and ``$NAME`` replaced by the names' columns; names that are not there stay."""
    for name, value in env.items():
        for form in (f"${{{name}}}", f"$({name})"):
            path = F.replace(path, F.lit(form), value)
        # The bare form ends where the name does: split, and put together again.
        path = F.array_join(F.split(path, r"\$" + name + r"(?![A-Za-z0-9_])", -1), "\u0001")
        path = F.replace(path, F.lit("\u0001"), value)
    return path
