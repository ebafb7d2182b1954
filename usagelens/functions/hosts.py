"""Host sets: expansion, compression and matching of names such as ``n[1-3,7].example``."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions.scalars import string_set_compare

_LIST = r"(?:[^,\[\]]++|\[[^\]]*+\])++"
_PART = r"(\[[^\]]*+\]|[^\[\]]++)"
# Most hosts of a list that is expanded to rows, or to one array; rows of a block; digits of a number.
MOST_HOSTS = 10_000_000
LISTED_HOSTS = 100_000
BLOCK = 4096
DIGITS = 18
# Private characters that stand for "a digit from a to b", at place 10 a + b.
_CLASSES = "".join(chr(0xE000 + i) for i in range(100))
_RANGES = r"\[\d++(?:-\d++)?+(?:,\d++(?:-\d++)?+)*+\]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_host_list(c: Column | str) -> Column:
    """Comma-separated patterns to an array; commas inside brackets do not separate."""
    return F.transform(F.regexp_extract_all(_col(c), F.lit(f"({_LIST})"), F.lit(1)), lambda x: F.trim(x))


def _intervals(c: Column | str) -> Column:
    """The list as names, each an array of parts (text, spans): a bracket has its ranges (lo, hi), other parts have NULL.

    NULL for an unsound list: an unclosed bracket, something else than numbers of up to 18 digits in one, or a range
    that goes down.  The size of the value follows the text, not the hosts it names.
    """

    def span(text: Column) -> Column:
        ends = F.split(text, "-")
        lo, hi = ends[0].try_cast("bigint"), F.element_at(ends, -1).try_cast("bigint")
        return F.when((lo <= hi) & (hi < 10**DIGITS), F.struct(lo.alias("lo"), hi.alias("hi")))

    def part(text: Column) -> Column:
        inner = F.regexp_extract(text, r"^\[(.*)\]$", 1)
        return F.struct(text.alias("text"), F.when(text.startswith("["), F.transform(F.split(inner, ","), span)).alias("spans"))

    def parts(name: Column) -> Column:
        return F.transform(F.regexp_extract_all(name, F.lit(_PART), F.lit(1)), part)

    names = F.transform(split_host_list(c), parts)
    closed = ~F.regexp_replace(_col(c), _RANGES, "").rlike(r"[\[\]]")
    rising = ~F.exists(names, lambda n: F.exists(n, lambda p: F.exists(F.coalesce(p.spans, F.array()), lambda s: s.isNull())))
    return F.when(closed, F.when(rising, names))


def _name_size(parts: Column) -> Column:
    """Number of hosts of a name; a double, so that no product overflows."""

    def choices(p: Column) -> Column:
        counted = F.aggregate(p.spans, F.lit(0.0), lambda a, s: a + (s.hi - s.lo + 1).cast("double"))
        return F.coalesce(counted, F.lit(1.0))

    return F.aggregate(parts, F.lit(1.0), lambda a, p: a * choices(p))


def _size(names: Column) -> Column:
    return F.aggregate(names, F.lit(0.0), lambda a, n: a + _name_size(n))


def host_list_size(c: Column | str) -> Column:
    """Number of hosts that a list names, decided on its ranges (a double, exact below 2^53); NULL if it is unsound."""
    return _size(_intervals(c))


def host_list_fault(c: Column | str, most: int = MOST_HOSTS) -> Column:
    """Why :func:`expand_hosts` gives no row for a list: ``unsound``, ``too many hosts``, or NULL if it gives them."""
    size = host_list_size(c)
    return F.when(_col(c).isNotNull() & size.isNull(), "unsound").when(size > most, "too many hosts")


def _texts(choices: Column) -> Column:
    """All texts that take one choice of every part, in order; ``choices`` is an array of arrays of texts."""
    longer = lambda heads, part: F.flatten(F.transform(heads, lambda h: F.transform(part, lambda x: F.concat(h, x))))
    return F.aggregate(choices, F.array(F.lit("")), longer)


def _expand(parts: Column) -> Column:
    numbers = lambda s: F.transform(F.sequence(s.lo, s.hi), lambda n: n.cast("string"))
    return _texts(F.transform(parts, lambda p: F.coalesce(F.flatten(F.transform(p.spans, numbers)), F.array(p.text))))


def expand_host_list(c: Column | str, most: int = LISTED_HOSTS) -> Column:
    """Compressed host list to an array of names; each name may hold any number of bracket ranges.

    NULL for an unsound list (an unclosed bracket, something else than numbers of up to 18 digits in one, a range that
    goes down) and for one of more than ``most`` hosts, which is told from the ranges before anything is
    expanded: use :func:`expand_hosts` or :func:`host_list_matches` for those.
    """
    names = _intervals(c)
    return F.when(_size(names) <= most, F.flatten(F.transform(names, _expand)))


def _nth(parts: Column, i: Column) -> Column:
    """The i-th text of a name: its numbers are the digits of i, the last bracket counting fastest."""

    def number(p: Column, at: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            width = s.hi - s.lo + 1
            here = a.n.isNull() & (a.left < width)
            return F.struct((a.left - F.when(a.n.isNull() & ~here, width).otherwise(0)).alias("left"), F.when(here, s.lo + a.left).otherwise(a.n).alias("n"))

        start = F.struct(at.alias("left"), F.lit(None).cast("bigint").alias("n"))
        return F.aggregate(p.spans, start, step, lambda a: a.n.cast("string"))

    def prepend(a: Column, p: Column) -> Column:
        width = F.coalesce(F.aggregate(p.spans, F.lit(0).cast("bigint"), lambda n, s: n + s.hi - s.lo + 1), F.lit(1).cast("bigint"))
        quotient = ((a.rest - a.rest % width) / width).cast("bigint")
        return F.struct(F.concat(F.coalesce(number(p, a.rest % width), p.text), a.text).alias("text"), quotient.alias("rest"))

    return F.aggregate(F.reverse(parts), F.struct(F.lit("").alias("text"), i.alias("rest")), prepend, lambda a: a.text)


def expand_hosts(df: DataFrame, col: str, out: str = "host", most: int = MOST_HOSTS) -> DataFrame:
    """One row per host of a compressed list.

    A name of many hosts is generated in blocks of 4,096 rows, so no array grows with a range.  Unsound lists and lists of
    more than ``most`` hosts, far beyond any cluster, give no rows and do not disturb others; :func:`host_list_fault` says which.
    """
    names = df.withColumn("_names", _intervals(col))
    name = names.select(*df.columns, F.explode(F.when(_size(F.col("_names")) <= most, F.col("_names"))).alias("_parts"))
    name = name.withColumn("_size", _name_size(F.col("_parts")).cast("bigint"))
    blocks = name.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_size") - 1, F.lit(BLOCK).cast("bigint"))))
    until = F.least(F.col("_size"), F.col("_at") + BLOCK) - 1
    block = F.transform(F.sequence("_at", until), lambda i: _nth(F.col("_parts"), i))
    texts = F.when(F.col("_size") <= BLOCK, _expand(F.col("_parts"))).otherwise(block)
    return blocks.withColumn(out, F.explode(texts)).drop("_parts", "_size", "_at")


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digit_runs(s: Column) -> Column:
    """A range of numbers as texts of digits and digit classes, at most two for each place of its shortest and longest numbers.

    A run is a head, a class for the next digit and any digits after it: 27 to 1234 gives [3-9]d, 2[7-9], [1-9]dd, 1[0-1]dd, ...
    Decided on the digits as text; lengths between those of both ends are one run each.
    """

    def run(head: Column, x: Column, y: Column, left: Column) -> Column:
        text = F.concat(head, F.substring(F.lit(_CLASSES), x * 10 + y + 1, F.lit(1)), F.repeat(F.lit(_CLASSES[9]), left))
        return F.when(x <= y, text)

    def of_place(e: Column, j: Column) -> Column:
        """What both ends share up to place j has one run, later places one below and one above."""
        digit = lambda text: F.substring(text, j + 1, F.lit(1)).cast("int")
        # An end's digit is left out of the class if its own tail is not a whole block.
        first = digit(e.lo) + (j < e.zeros - 1).cast("int")
        final = digit(e.hi) - (j < e.nines - 1).cast("int")
        left = e.n - j - 1
        below = F.when(j < e.zeros, run(F.substring(e.lo, F.lit(1), j), first, F.lit(9), left))
        above = F.when(j < e.nines, run(F.substring(e.hi, F.lit(1), j), F.lit(0), final, left))
        return F.when(j > e.same, F.array(below, above)).otherwise(F.array(run(F.substring(e.lo, F.lit(1), j), first, final, left)))

    def of_length(n: Column, lo: Column, hi: Column) -> Column:
        """Numbers of n digits: from ``lo``, or the least, to ``hi``, or the greatest."""
        low = F.when(n == F.length(lo), lo).otherwise(F.rpad(F.lit("1"), n, F.lit("0")))
        high = F.when(n == F.length(hi), hi).otherwise(F.repeat(F.lit("9"), n))

        def same(t: Column) -> Column:
            equal = F.filter(F.sequence(F.lit(1), n - 1), lambda j: F.substring(t.lo, F.lit(1), j) == F.substring(t.hi, F.lit(1), j))
            return F.when(n > 1, F.size(equal)).otherwise(0)

        def ends(t: Column) -> Column:
            # Digits up to the last that is not 0 below, not 9 above; how many leading digits are the same, the last never counted.
            zeros, nines = F.length(F.rtrim(t.lo, F.lit("0"))), F.length(F.rtrim(t.hi, F.lit("9")))
            return F.struct(t.lo.alias("lo"), t.hi.alias("hi"), n.alias("n"), zeros.alias("zeros"), nines.alias("nines"), same(t).alias("same"))

        places = lambda e: F.flatten(F.transform(F.sequence(e.same, n - 1), lambda j: of_place(e, j)))
        some = _bind(F.struct(low.alias("lo"), high.alias("hi")), lambda t: _bind(ends(t), places))
        between = (n > F.length(lo)) & (n < F.length(hi))
        return F.when(between, F.array(F.concat(F.lit(_CLASSES[19]), F.repeat(F.lit(_CLASSES[9]), n - 1)))).otherwise(some)

    def all_lengths(t: Column) -> Column:
        lengths = F.sequence(F.length(t.lo), F.length(t.hi))
        return F.array_compact(F.flatten(F.transform(lengths, lambda n: of_length(n, t.lo, t.hi))))

    return _bind(F.struct(s.lo.cast("string").alias("lo"), s.hi.cast("string").alias("hi")), all_lengths)


def host_list_matches(c: Column | str, patterns: list[str], prefix: bool = False) -> Column:
    """True where a compressed list names a host that matches a pattern; NULL if the list is unsound.

    Nothing is expanded: ranges become texts with classes of digits, and the pattern's digits match every class they lie in.
    """
    regex = "|".join(host_pattern_regex(p, prefix, classes=True) for p in patterns)
    runs = lambda parts: _texts(F.transform(parts, lambda p: F.coalesce(F.flatten(F.transform(p.spans, _digit_runs)), F.array(p.text))))
    return F.exists(_intervals(c), lambda name: F.exists(runs(name), lambda text: text.rlike(regex)))


def compress_hosts(df: DataFrame, keys: list[str], host: str = "host", out: str = "hosts") -> DataFrame:
    """Compressed text of the distinct hosts of each key, names in text order.

    Names fall into families (prefix, text after the number, domain); a family's numbers become ranges
    by gaps and islands.  Everything up to the last step works on (key, family, number) rows, which are dealt out
    by family once, so that what a task holds follows the size of a shuffle partition and not of a part of the
    input; the lists built at the end are those of the result.
    """
    pattern = r"^(.*?)(\d+)(\D*)$"
    names = df.select(*keys, F.col(host).alias("_h"))
    first = F.substring_index(F.col("_h"), ".", 1)
    # Numbers beyond a bigint stay part of the name.
    number = F.regexp_extract(first, pattern, 2).try_cast("bigint")
    numbered = number.isNotNull()
    parts = names.select(
        *keys,
        "_h",
        F.when(numbered, F.regexp_extract(first, pattern, 1)).otherwise(first).alias("_pre"),
        F.when(numbered, F.regexp_extract(first, pattern, 3)).otherwise("").alias("_post"),
        F.when(F.col("_h").contains("."), F.expr("substr(_h, instr(_h, '.'))")).otherwise("").alias("_dom"),
        number.alias("_n"),
    )
    family = [*keys, "_pre", "_post", "_dom"]
    w = Window.partitionBy(*family).orderBy("_n")
    # A host that occurs twice has the same rank, so it needs no step of its own.
    islands = parts.repartition(*family).withColumn("_island", F.col("_n") - F.dense_rank().over(w))
    spans = islands.groupBy(*family, "_island").agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi"))
    text = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo").cast("string")).otherwise(
        F.concat_ws("-", F.col("_lo").cast("string"), F.col("_hi").cast("string"))
    )
    ranges = spans.groupBy(*family).agg(
        F.array_sort(F.collect_list(F.when(F.col("_lo").isNotNull(), F.struct("_lo", text.alias("_s"))))).alias("_r"),
        F.sum(F.col("_hi") - F.col("_lo") + 1).alias("_count"),
    )
    joined = F.array_join(F.col("_r._s"), ",")
    digits = (
        F.when(F.col("_count").isNull(), "")
        .when(F.col("_count") == 1, joined)
        .otherwise(F.concat(F.lit("["), joined, F.lit("]")))
    )
    named = ranges.select(*keys, F.concat("_pre", digits, "_post", "_dom").alias("_name"))
    return named.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("_name")), ",").alias(out))


def _digit_regex(lo: int, hi: int, classes: bool) -> str:
    """Regular expression of a digit from lo to hi; with ``classes`` also of the classes that share one with it."""
    digits = str(lo) if lo == hi else f"[{lo}-{hi}]"
    if not classes:
        return digits
    shared = "".join(_CLASSES[10 * a + b] for a in range(hi + 1) for b in range(max(a, lo), 10))
    return f"[{lo}-{hi}{shared}]"


def _number_regex(lo: int, hi: int, classes: bool) -> list[str]:
    """Alternatives for the numbers from lo to hi, a few for each digit instead of one for each number."""
    if len(str(lo)) < len(str(hi)):
        cut = 10 ** len(str(lo))
        return _number_regex(lo, cut - 1, classes) + _number_regex(cut, hi, classes)
    if hi < 10:
        return [_digit_regex(lo, hi, classes)]
    out = []
    first, last = lo // 10, hi // 10
    if first == last or lo % 10:
        head = "".join(_digit_regex(int(d), int(d), classes) for d in str(first))
        out.append(head + _digit_regex(lo % 10, hi % 10 if first == last else 9, classes))
        first += 1
    if first <= last and hi % 10 < 9:
        head = "".join(_digit_regex(int(d), int(d), classes) for d in str(last))
        out.append(head + _digit_regex(0, hi % 10, classes))
        last -= 1
    if first <= last:
        out += [x + _digit_regex(0, 9, classes) for x in _number_regex(first, last, classes)]
    return out


def host_pattern_regex(pattern: str, prefix: bool = False, classes: bool = False) -> str:
    """Regular expression of one host pattern: ``*`` stays inside a name element, ``[1-3,7]`` are numbers.

    With ``prefix`` the pattern may match the leading elements of a longer name; with ``classes`` digits also match the
    classes of :func:`host_list_matches`.
    """

    def literal(text: str) -> str:
        return "".join(_digit_regex(int(x), int(x), classes) if x in "0123456789" else re.escape(x) for x in text)

    out = []
    pos = 0
    for m in re.finditer(r"\*|\[([0-9,\-\s]+)\]", pattern):
        out.append(literal(pattern[pos : m.start()]))
        pos = m.end()
        if m.group(0) == "*":
            out.append("[^.]*")
            continue
        numbers: list[str] = []
        for span in m.group(1).split(","):
            lo, _, hi = span.strip().partition("-")
            if hi and int(lo) > int(hi):
                raise ValueError(f"invalid range in host pattern: {pattern}")
            numbers.extend(_number_regex(int(lo), int(hi or lo), classes))
        out.append("(?:" + "|".join(numbers) + ")")
    rest = pattern[pos:]
    if not pattern or "[" in rest:
        raise ValueError(f"invalid host pattern: {pattern!r}")
    out.append(literal(rest))
    return "^" + "".join(out) + (r"(?:\..*)?$" if prefix else "$")


def host_matches(c: Column | str, patterns: list[str], prefix: bool = False) -> Column:
    """True where the host matches any pattern.

    Exact names become an ``isin`` so that they reach the Parquet scan.  For wildcards the literal heads
    are added as ``startswith`` conjuncts, which are pushed down too, and the regular expression decides.
    """
    c = _col(c)
    plain = [p for p in patterns if not re.search(r"[*\[]", p)]
    if len(plain) == len(patterns) and not prefix:
        return c.isin(patterns)
    regex = c.rlike("|".join(host_pattern_regex(p, prefix) for p in patterns))
    heads = sorted({re.split(r"[*\[]", p, maxsplit=1)[0] for p in patterns})
    if all(heads):
        lossy = c.startswith(heads[0])
        for h in heads[1:]:
            lossy = lossy | c.startswith(h)
        return lossy & regex
    return regex


def match_hosts(df: DataFrame, patterns: list[str], prefix: bool = False, host: str = "host") -> DataFrame:
    return df.filter(host_matches(host, patterns, prefix)) if patterns else df


def host_set_compare(a: Column | str, b: Column | str, op: str) -> Column:
    """Set relation of two host arrays; see :func:`string_set_compare`."""
    return string_set_compare(a, b, op)
