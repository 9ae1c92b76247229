"""Parsing of question texts and model answers; all of it built-in column functions."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEWLINE = "\n"
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Patterns that decide what a stem, an option and a literal is.
T1_OPTION_LINE = r"(?dmU)^\s*(?:[A-E]\.\s+|\([A-E]\)\s*[\.\)]?\s*)"
COMPOSITE_OPTION_LINE = r"(?dm)^\p{L}\."
MCQ_DOT_LINE = r"(?dmU)^\s*[A-Z]\.\s+"
MCQ_PAREN = r"\([A-Z]\)"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
ANSWER_LABEL = r"(?d)^([A-Z])(?:[.\u3002,:; ].*)?\z"
LITERALS = (
    r"(?i)<image\s*\d+>",
    r"\$[^$]+\$",
    r"\b\d+(?:\.\d+)?\s*(?:mL|L|M|mol|mmol|g|kg|cm|mm|%|K|°C|N)\b",
    r"\b\d+(?:\.\d+)?\b",
    r"\b(?:[A-Z][a-z]?\d*){2,}\b",
    r"\b[a-zA-Z][a-zA-Z\-]*\s+(?:acid|base)\b",
)
PHRASES = ("titration curve", "equivalence point", "pH")
SCORE_LINE = r"(?idmU)(?:^|\n)\s*score\s*[:\uff1a-]\s*([0-9]{1,3})\s*(?:/\s*100|out\s+of\s+100)?\s*$"
FAILURES = ("[ERROR]", "Error:", "Exception:")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the columns, each worked out once a row however often it is used later: filters and projections stay above."""
    names = [f"_once_{n}" for n in columns]  # other names first, so that columns of ``df`` can be replaced
    own = df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in zip(names, columns.values(), strict=True)]))))
    return own.drop(*columns).withColumnsRenamed(dict(zip(names, columns, strict=True)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` refers to it in a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def _halves(query: Column, at: Column) -> Column:
    """(stem, options), both trimmed; no option line leaves the options empty."""
    return let(
        at,
        lambda at: F.struct(
            strip(F.when(at > 0, F.substring(query, F.lit(1), at - 1)).otherwise(query)).alias("stem"),
            strip(F.when(at > 0, F.substring(query, at, F.length(query))).otherwise(F.lit(""))).alias("options"),
        ),
    )


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def split_query(query: Column) -> Column:
    """Split for paraphrases: the first line that starts with ``A.`` to ``E.`` or ``(A)`` to ``(E)``."""
    q = F.coalesce(query, F.lit(""))
    return _halves(q, F.regexp_instr(q, F.lit(T1_OPTION_LINE)))


def split_lines(query: Column) -> Column:
    """Split for composites at the first line that starts with a letter and a dot, not indented; nothing is trimmed."""
    q = F.coalesce(query, F.lit(""))
    return let(
        F.regexp_instr(q, F.lit(COMPOSITE_OPTION_LINE)),
        lambda at: F.struct(
            F.when(at > 1, F.substring(q, F.lit(1), at - 2)).when(at == 1, F.lit("")).otherwise(q).alias("stem"),
            F.when(at > 0, F.substring(q, at, F.length(q))).otherwise(F.lit("")).alias("options"),
        ),
    )


def split_mcq(query: Column) -> Column:
    q = F.coalesce(query, F.lit(""))
    dot = F.regexp_instr(q, F.lit(MCQ_DOT_LINE))
    return _halves(q, let(dot, lambda at: F.when(at > 0, at).otherwise(F.regexp_instr(q, F.lit(MCQ_PAREN)))))


def combine_t2t4(t2: Column, t4: Column) -> Column:
    """The stem of T2 with the options of T4; the whole query stands in for a part that is empty."""
    stem = let(split_lines(t2)["stem"], lambda x: F.when(x == "", t2).otherwise(x))
    options = let(split_lines(t4)["options"], lambda x: F.when(x == "", t4).otherwise(x))
    joined = lambda h: F.when(h["o"] != "", F.concat(h["s"], F.lit(NEWLINE), h["o"])).otherwise(h["s"])
    return let(F.struct(stem.alias("s"), options.alias("o")), joined)


def _last_per_label(pairs: Column) -> Column:
    """For each label its last text, in order of the labels' first places."""
    last = lambda own, k: F.element_at(F.filter(own, lambda p: p["label"] == k), -1)
    return let(pairs, lambda own: F.transform(F.array_distinct(F.transform(own, lambda p: p["label"])), lambda k: last(own, k)))


def parse_options(query: Column) -> Column:
    """array<struct<label,text>>: options by ``A.`` lines, or by ``(A)`` up to the next such mark if those are fewer than two."""
    q = F.coalesce(query, F.lit(""))
    option = lambda label, text: F.struct(label.alias("label"), strip(text).alias("text"))
    lines = F.filter(F.split(q, LINE_ENDS), lambda x: x.rlike(r"(?U)^\s*[A-Z]\.."))
    dotted = _last_per_label(F.transform(lines, lambda x: option(F.regexp_extract(x, r"(?U)^\s*([A-Z])\.", 1), F.regexp_extract(x, r"(?sU)^\s*[A-Z]\.(.*)$", 1))))
    marked = r"(?s)\(([A-Z])\)(.*?)(?=\([A-Z]\)|\z)"
    paren = F.zip_with(F.regexp_extract_all(q, F.lit(marked), 1), F.regexp_extract_all(q, F.lit(marked), 2), option)
    told = lambda own: F.when(F.size(own) >= 2, _last_per_label(F.filter(own, lambda o: o["text"] != ""))).otherwise(F.slice(own, 1, 0))
    return let(dotted, lambda own: F.when(F.size(own) >= 2, own).otherwise(let(paren, told)))


def is_mcq(query: Column) -> Column:
    return F.size(parse_options(query)) >= 2


#: White space that isn't a space of its own: most texts have none, and looking costs less than replacing.
_ODD_SPACE = r"(?U)\s\s|[^\S ]"


def match_key(text: Column) -> Column:
    return F.lower(strip(F.when(text.rlike(_ODD_SPACE), F.regexp_replace(text, r"(?U)\s+", " ")).otherwise(text)))


def plain_key(text: Column) -> Column:
    return F.lower(strip(text))


def dedup_keep_order(items: Column, key: Callable[[Column], Column] = match_key) -> Column:
    """The items without blanks, and without those whose key came before."""
    keyed = F.transform(F.array_distinct(items), lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    # Sorted by key, the first of equal keys stays; then the old order is taken up again.
    first = lambda own: F.filter(own, lambda s, j: (j == 0) | (F.get(own, j - 1)["k"] != s["k"]))
    kept = let(F.sort_array(F.filter(keyed, lambda s: s["k"] != "")), first)
    return F.transform(F.sort_array(F.transform(kept, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x")))), lambda s: s["x"])


#: Signs without one of which a pattern has no match: they are looked for first, as that costs less.
_SIGNS = {LITERALS[0]: ("<",), LITERALS[1]: ("$",), LITERALS[5]: ("acid", "base")}


def _all_where(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    if pattern not in _SIGNS:
        return found
    return F.when(reduce(or_, [text.contains(x) for x in _SIGNS[pattern]]), found).otherwise(F.array().cast("array<string>"))


def immutable_literals(stem: Column) -> Column:
    found = [_all_where(stem, p) for p in LITERALS]
    found += [F.slice(F.regexp_extract_all(stem, F.lit(f"(?i){p}"), 0), 1, 1) for p in PHRASES]
    return dedup_keep_order(F.concat(*found))


def sanitize_checklist(items: Column, stem: Column, literals: Column) -> Column:
    """(kept, dropped): an item stays if the stem has it and it is one of the stem's ``literals``."""
    facts = F.struct(match_key(stem).alias("stem"), F.transform(literals, match_key).alias("allowed"), dedup_keep_order(items).alias("items"))

    def sort_out(f: Column) -> Column:
        good = lambda x: f["stem"].contains(match_key(x)) & F.array_contains(f["allowed"], match_key(x))
        return F.struct(F.filter(f["items"], good).alias("kept"), F.filter(f["items"], lambda x: ~good(x)).alias("dropped"))

    return let(facts, sort_out)


def missing_items(items: Column, text: Column) -> Column:
    """Checklist items that the new text lacks; verification passes if there are none."""
    return F.when(F.size(items) == 0, items).otherwise(let(match_key(text), lambda whole: F.filter(items, lambda x: ~whole.contains(match_key(x)))))


def normalize_checklist(raw: Column) -> Column:
    """An array from a JSON array in text, or else from lines."""
    listed = F.from_json(raw, "array<string>")
    return F.filter(F.transform(F.coalesce(listed, F.split(raw, NEWLINE)), strip), lambda x: x != "")


def extract_json(raw: Column) -> Column:
    """A VARIANT object: the whole answer, or its part from the first ``{`` to the last ``}``; else null."""
    whole = F.try_parse_json(strip(raw))
    part = F.try_parse_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0))
    parsed = F.coalesce(whole, part)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def json_text(value: Column, *names: str) -> Column:
    """The first of the named fields that is there and not empty, as text."""
    return F.coalesce(*[F.nullif(F.try_variant_get(value, f"$.{n}", "string"), F.lit("")) for n in names])


def strip_fence(raw: Column) -> Column:
    inner = F.regexp_extract(raw, r"(?is)```(?:[a-z0-9_+-]*)[ \t]*\n(.*?)```", 1)
    return strip(F.when(inner != "", inner).otherwise(raw))


def parse_score(raw: Column) -> Column:
    """The first line that is a score and nothing else, such as ``Score: 95/100``; 100 at most, null if there is none."""
    found = F.regexp_extract(raw, SCORE_LINE, 1)
    return F.when(found != "", F.least(F.lit(100), found.try_cast("int")))  # no sign is matched, so 0 is the least


def verdict_passes(raw: Column) -> Column:
    """True if the answer, without case and outer marks, is ``no``."""
    return F.btrim(F.lower(F.coalesce(raw, F.lit(""))), F.lit(" .,!?:;\"'\n\t")) == "no"


def clean_plan(plan: Column) -> Column:
    """The first three edits, of those the ones with text and position."""
    trimmed = F.transform(F.slice(plan, 1, 3), lambda e: F.struct(F.trim(e["text"]).alias("text"), F.trim(e["position"]).alias("position")))
    return F.filter(trimmed, lambda e: (e["text"] != "") & (e["position"] != ""))


def clean_keywords(words: Column, most: int) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != "")), 1, most)


def word_count_en(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[A-Za-z]+('[A-Za-z]+)?"))


def answer_label(target: Column) -> Column:
    """The label of a target such as ``B``, ``b``, ``B. text``, ``B, text`` or ``B text``; else empty."""
    return F.regexp_extract(F.upper(strip(target)), ANSWER_LABEL, 1)


def result_ok(status: Column, output: Column) -> Column:
    bad = F.lit(False)
    for mark in FAILURES:
        bad = bad | F.coalesce(output, F.lit("")).contains(mark)
    return (F.coalesce(status, F.lit("")) == "ok") & ~bad


def chem_key(text: Column) -> Column:
    """Formula text without count in front, dollars, subscripts' marks, phase and spaces."""
    s = F.regexp_replace(F.regexp_replace(F.trim(text), r"^\d+\s*", ""), r"[\s$]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"([A-Z][a-z]?|[)\]])_\{(\d+)\}", "$1$2"), r"([A-Z][a-z]?|[)\]])_(\d)", "$1$2")
    return F.regexp_replace(s, r"(?i)\((?:aq|s|l|g|cr|amorph)\)$", "")


_ATOM_OR_MARK = r"[A-Z][a-z]?|[0-9]+|[()\[\]]"
_FORMULA = r"^(?:[A-Z][a-z]?[0-9]{0,9}|[(\[]|[)\]][0-9]{0,9})+\z"


def _atoms(part: Column) -> Column:
    """array<struct<e,n>> of a formula with groups, its count in front taken out; null if it is none or brackets don't match.

    Read from its end, a number comes before what it counts: a closing bracket puts the group's factor onto a stack, and
    the opening one takes it off.
    """
    count = F.coalesce(F.regexp_extract(part, r"^([0-9]{1,9})", 1).try_cast("long"), F.lit(1).cast("long"))
    body = F.regexp_replace(part, r"^[0-9]+", "")
    start = F.struct(F.lit(None).cast("long").alias("n"), F.array(count).alias("stack"), F.array().cast("array<struct<e:string,n:bigint>>").alias("atoms"), F.lit(True).alias("good"))

    def step(s: Column, t: Column) -> Column:
        top = F.coalesce(F.get(s["stack"], F.size(s["stack"]) - 1), F.lit(0).cast("long"))
        times = top * F.coalesce(s["n"], F.lit(1).cast("long"))
        is_number, closes, opens = t.rlike("^[0-9]"), t.isin(")", "]"), t.isin("(", "[")
        stack = F.when(closes, F.array_append(s["stack"], times)).when(opens, F.slice(s["stack"], 1, F.greatest(F.size(s["stack"]) - 1, F.lit(0)))).otherwise(s["stack"])
        atoms = F.when(is_number | closes | opens, s["atoms"]).otherwise(F.array_append(s["atoms"], F.struct(t.alias("e"), times.alias("n"))))
        return F.struct(F.when(is_number, t.try_cast("long")).alias("n"), stack.alias("stack"), atoms.alias("atoms"), (s["good"] & (~opens | (F.size(s["stack"]) > 1))).alias("good"))

    done = F.aggregate(F.reverse(F.regexp_extract_all(body, F.lit(_ATOM_OR_MARK), 0)), start, step)
    return F.when(body.rlike(_FORMULA), let(done, lambda d: F.when(d["good"] & (F.size(d["stack"]) == 1), d["atoms"])))


def element_counts(formula: Column) -> Column:
    """Sorted ``El:n`` texts of a formula such as ``Ca(OH)2`` or ``CuSO4·5H2O``; null if it is none."""

    def counted(parts: Column) -> Column:
        names = lambda atoms: F.array_sort(F.array_distinct(F.transform(atoms, lambda a: a["e"])))
        total = lambda atoms, e: F.aggregate(F.filter(atoms, lambda a: a["e"] == e), F.lit(0).cast("long"), lambda n, a: n + a["n"])
        said = lambda atoms: F.transform(names(atoms), lambda e: F.concat_ws(":", e, total(atoms, e).cast("string")))
        return F.when(~F.exists(parts, lambda p: p.isNull()), let(F.flatten(parts), said))

    return let(F.transform(F.split(formula, "[·•⋅*.]"), _atoms), counted)


#: Symbol, factor to kg, m, s, mol, K, A and cd, and the powers of these.
BASE_UNITS = {
    "g": (1e-3, "kg"), "m": (1.0, "m"), "s": (1.0, "s"), "mol": (1.0, "mol"), "K": (1.0, "K"), "A": (1.0, "A"), "cd": (1.0, "cd"), "lm": (1.0, "cd"), "lx": (1.0, "cd /m /m"),
    "L": (1e-3, "m m m"), "l": (1e-3, "m m m"), "N": (1.0, "kg m /s /s"), "J": (1.0, "kg m m /s /s"), "W": (1.0, "kg m m /s /s /s"), "Pa": (1.0, "kg /m /s /s"),
    "V": (1.0, "kg m m /s /s /s /A"), "C": (1.0, "s A"), "Hz": (1.0, "/s"), "M": (1000.0, "mol /m /m /m"), "eV": (1.602176634e-19, "kg m m /s /s"),
    "ohm": (1.0, "kg m m /s /s /s /A /A"), "\u03a9": (1.0, "kg m m /s /s /s /A /A"), "\u2126": (1.0, "kg m m /s /s /s /A /A"), "S": (1.0, "s s s A A /kg /m /m"), "F": (1.0, "s s s s A A /kg /m /m"),
    "T": (1.0, "kg /s /s /A"), "Wb": (1.0, "kg m m /s /s /A"), "H": (1.0, "kg m m /s /s /A /A"), "Bq": (1.0, "/s"), "Gy": (1.0, "m m /s /s"), "Sv": (1.0, "m m /s /s"), "bar": (1e5, "kg /m /s /s"), "cal": (4.184, "kg m m /s /s"), "Wh": (3600.0, "kg m m /s /s"), "t": (1000.0, "kg"), "rad": (1.0, ""),
}
OTHER_UNITS = {
    "min": (60.0, "s"), "h": (3600.0, "s"), "hr": (3600.0, "s"), "d": (86400.0, "s"), "week": (604800.0, "s"), "atm": (101325.0, "kg /m /s /s"), "mmHg": (133.322387415, "kg /m /s /s"), "torr": (101325.0 / 760, "kg /m /s /s"), "Torr": (101325.0 / 760, "kg /m /s /s"), "psi": (6894.757293168361, "kg /m /s /s"),
    "inch": (0.0254, "m"), "in": (0.0254, "m"), "ft": (0.3048, "m"), "foot": (0.3048, "m"), "feet": (0.3048, "m"), "yd": (0.9144, "m"), "yard": (0.9144, "m"), "mi": (1609.344, "m"), "mile": (1609.344, "m"), "angstrom": (1e-10, "m"), "\u00c5": (1e-10, "m"), "ha": (1e4, "m m"),
    "lb": (0.45359237, "kg"), "oz": (0.028349523125, "kg"), "Da": (1.66053906660e-27, "kg"), "gal": (3.785411784e-3, "m m m"), "dyn": (1e-5, "kg m /s /s"), "erg": (1e-7, "kg m m /s /s"), "hp": (745.6998715822702, "kg m m /s /s /s"), "mph": (0.44704, "m /s"), "rpm": (0.10471975511965977, "/s"),
    "%": (0.01, ""), "ppm": (1e-6, ""), "deg": (0.017453292519943295, ""),
}
NAMES = {
    "meter": "m", "metre": "m", "liter": "L", "litre": "L", "gram": "g", "second": "s", "mole": "mol", "minute": "min", "hour": "h", "day": "d", "newton": "N", "joule": "J", "watt": "W", "pascal": "Pa", "volt": "V", "kelvin": "K",
    "ampere": "A", "coulomb": "C", "hertz": "Hz", "ohm": "ohm", "tesla": "T", "farad": "F", "henry": "H", "weber": "Wb", "siemens": "S", "tonne": "t", "calorie": "cal", "electronvolt": "eV", "radian": "rad", "degree": "deg", "pound": "lb", "ounce": "oz", "gallon": "gal", "percent": "%",
}
PREFIXES = {"": 1.0, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "da": 1e1, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "\u00b5": 1e-6, "\u03bc": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15}
LONG_PREFIXES = {"": 1.0, "tera": 1e12, "giga": 1e9, "mega": 1e6, "kilo": 1e3, "hecto": 1e2, "deca": 1e1, "deci": 1e-1, "centi": 1e-2, "milli": 1e-3, "micro": 1e-6, "nano": 1e-9, "pico": 1e-12, "femto": 1e-15}
DIMENSIONS = ("kg", "m", "s", "mol", "K", "A", "cd")


def unit_table() -> dict[str, tuple[float, tuple[int, ...]]]:
    """symbol -> (factor, power of each dimension): base units with every prefix, and names with theirs and a plural."""
    powers = lambda parts: tuple(parts.split().count(d) - parts.split().count("/" + d) for d in DIMENSIONS)
    every = {p + u: (x * f, powers(d)) for u, (f, d) in BASE_UNITS.items() for p, x in PREFIXES.items()}
    every |= {u: (f, powers(d)) for u, (f, d) in (OTHER_UNITS | BASE_UNITS).items()}
    return every | {p + name + end: (x * every[u][0], every[u][1]) for name, u in NAMES.items() for p, x in LONG_PREFIXES.items() for end in ("", "s")}


_NUMBER = r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_POWER = r"(?:\s*(?:\^|\*\*)\s*\(?([-+]?[0-9]{1,2})\)?)?"
#: A unit or an opening bracket with the sign before it, or a closing bracket, each with the power after it.
_TOKEN = rf"(/|\*(?!\*)|\u00b7|\u22c5|)\s*([A-Za-z%\u00b5\u03bc\u03a9\u2126\u00c5]+|\((?![-+]?[0-9])|\)){_POWER}\s*"


def quantity(text: Column) -> Column:
    """struct<value, factor, powers> of a number with units such as ``36 km/h``, ``1,000 mL`` or ``8.314 J/(mol*K)``; null if it is none."""
    # One constant: a map of a few hundred entries as an expression would be planned entry by entry.
    known = F.from_json(F.lit(json.dumps({u: {"f": f, "d": d} for u, (f, d) in unit_table().items()})), "map<string,struct<f:double,d:array<int>>>")
    nothing = F.array(*[F.lit(0)] * len(DIMENSIONS))
    frame = lambda sign, factor, powers: F.struct(sign.alias("sign"), factor.alias("factor"), powers.alias("powers"))

    def measured(plain: Column) -> Column:
        value = F.regexp_extract(plain, rf"^({_NUMBER})", 1)
        units = strip(F.regexp_replace(plain, rf"^{_NUMBER}", ""))
        at = [F.regexp_extract_all(units, F.lit(_TOKEN), i) for i in (1, 2, 3)]
        # Without a bracket in between, a second sign has nothing to stand before.
        shape = (value != "") & units.rlike(rf"^(?:{_TOKEN})*\z") & ~units.rlike(r"^[*\u00b7\u22c5]|\(\s*[*/]|[*/]\s*\)|\(\s*\)")
        sign = lambda z: F.when(z["0"] == "/", -1).otherwise(1)
        part = lambda z: F.struct(z["1"].alias("name"), known[z["1"]].alias("unit"), sign(z).alias("sign"), F.coalesce(z["2"].try_cast("int"), F.lit(1)).alias("power"))
        parts = F.transform(F.arrays_zip(at[0].alias("0"), at[1].alias("1"), at[2].alias("2")), part)
        return F.struct(value.alias("value"), parts.alias("parts"), shape.alias("whole"))

    def step(s: Column, t: Column) -> Column:
        """The stack has a frame for each open bracket: its sign, and what it holds so far."""
        n = F.size(s["stack"])
        last = F.get(s["stack"], n - 1)
        outer = F.get(s["stack"], n - 2)
        rest = lambda k: F.slice(s["stack"], 1, F.greatest(n - k, F.lit(0)))
        grown = lambda onto, factor, powers, power: frame(onto["sign"], onto["factor"] * F.pow(factor, power), F.zip_with(onto["powers"], powers, lambda i, j: i + j * power))
        opened = F.array_append(s["stack"], frame(t["sign"], F.lit(1.0), nothing))
        closed = F.array_append(rest(2), grown(outer, last["factor"], last["powers"], last["sign"] * t["power"]))
        plain = F.array_append(rest(1), grown(last, t["unit"]["f"], t["unit"]["d"], t["sign"] * t["power"]))
        opens, closes = t["name"] == "(", t["name"] == ")"
        good = F.when(opens, F.lit(True)).when(closes, n > 1).otherwise(t["unit"].isNotNull())
        return F.struct(F.when(~good, s["stack"]).when(opens, opened).when(closes, closed).otherwise(plain).alias("stack"), (s["good"] & good).alias("good"))

    def grown(q: Column) -> Column:
        start = F.struct(F.array(frame(F.lit(1), F.lit(1.0), nothing)).alias("stack"), F.lit(True).alias("good"))
        done = F.aggregate(q["parts"], start, step)
        found = lambda d: F.when(d["good"] & (F.size(d["stack"]) == 1), F.struct(q["value"].try_cast("double").alias("value"), F.get(d["stack"], 0)["factor"].alias("factor"), F.get(d["stack"], 0)["powers"].alias("powers")))
        return F.when(q["whole"], let(done, found))

    return let(let(strip(F.replace(text, F.lit(","), F.lit(""))), measured), grown)


def unit_equal(a: Column, b: Column) -> Column:
    """Same dimension, and values in b's unit within 1e-9 of the larger one, or of 1."""

    def close(q: Column) -> Column:
        x, y = q["x"]["value"] * q["x"]["factor"] / q["y"]["factor"], q["y"]["value"]
        return (q["x"]["powers"] == q["y"]["powers"]) & (F.abs(x - y) <= 1e-9 * F.greatest(F.abs(x), F.abs(y), F.lit(1.0)))

    return F.coalesce(let(F.struct(quantity(a).alias("x"), quantity(b).alias("y")), close), F.lit(False))


def math_key(text: Column) -> Column:
    """A formula without outer dollars, spaces and degree signs, powers written as ``**``; case counts (m is not M)."""
    s = F.regexp_replace(F.regexp_replace(strip(text), r"(?s)^\$(.*)\$\z", "$1"), r"(?U)\s", "")
    for old, new in ((r"\\rightarrow|\u2192", "-"), (r"\\degree|\^\\circ", ""), (r"\^\{([^}]+)\}", r"**($1)"), (r"\^([0-9])", "**$1"), (r"\^", "**"), (r"\*\*\(([0-9]+|[A-Za-z])\)", "**$1")):
        s = F.regexp_replace(s, old, new)
    return s


def pair_equal(kind: Column, a: Column, b: Column) -> Column:
    """Equality of an original and its rewriting by kind; equal text always passes, unknown kinds never."""
    formula = F.coalesce(F.to_json(element_counts(chem_key(a))) == F.to_json(element_counts(chem_key(b))), F.lit(False))
    by_kind = F.when(kind == "unit", unit_equal(a, b)).when(kind == "chem", formula).when(kind == "math", math_key(a) == math_key(b)).otherwise(False)
    return (F.trim(a) == F.trim(b)) | by_kind
