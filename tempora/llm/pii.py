"""Personal data, with DataFrame functions only: generators propose spans, boosted trees choose among them.

Base spans follow fixed rules (pattern, then a check, no retries) and always stay. Generators with a wider net propose
more: numbers written like telephone numbers without a plus sign, cards with a failed check digit or other lengths,
addresses with octets above 255, addresses whose at sign is spelt. Features of format and context go to gradient-boosted
trees, trained here on the driver from a bounded sample (`rows`, `spans`: parameters) of the corpus's own candidates and
altered copies of them, held as CASE expressions, and per-kind thresholds calibrated on a held part choose what is
added. Every pattern is free of nested backtracking: possessive runs that may start only where a run starts or where
the last match ended, so a text of one long run costs linear time.

Positions: the text split by a pattern and the matches alternate, so their lengths give code point offsets.

Edge cases: null and empty texts have no spans; every row returns one row; ids pass through.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, durable

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the base rules, written for java.util.regex without backtracking.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Where a number written with blanks, dots or dashes may start: not inside another.
NOT_INSIDE = r"(?<![0-9+(./-])(?<![0-9)] )"
#: Wider nets: (kind, pattern, a cheap test that a text can match at all).
WIDER = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)++", r"[\[(]at[\])]"),
    ("phone", NOT_INSIDE + r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[ .-][0-9])", r"[0-9]{3}[ .-][0-9]{4}"),
    ("phone", NOT_INSIDE + r"(?=(?:[ ./()-]{0,2}[0-9]){9,12}(?![ ./-]?[0-9]))(?:\(0[0-9]{1,4}\) ?|0[0-9]{1,4}[ ./-])[0-9]{2,8}(?:[ .-][0-9]{2,4}){0,4}(?![0-9])", r"0[0-9]{1,4}\)?[ ./-]?[0-9]"),
)
#: Characters of context on each side.
CONTEXT = 16
#: Spans placed at once; three levels of pieces keep the cost near linear up to millions of spans a text.
PIECE = 64
N_FEATURES = 16


def _spans(text: Column, pattern: str, possible: Column) -> Column:
    """array<struct<s, e, m, before, after>> of a pattern's matches in text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(possible, _let(F.struct(found.alias("m"), text.alias("t")), lambda x: _placed(x, pattern))).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<s: int, e: int, m: string, before: string, after: string>>"


def _starts(lengths: Column, levels: int = 3, add=lambda a, b: a + b) -> Column:
    """The sum of what stands before each element; with F.greatest as `add` the greatest of it, from 0. A list grown one by one
    is copied each time, so it is grown in pieces of PIECE, whose own starts come the same way: the cost grows with the number
    of elements, not with its square."""
    if not levels:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(lengths, none, lambda acc, n: F.struct(add(acc["at"], n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
    pieces = F.transform(F.sequence(F.lit(1), F.size(lengths), F.lit(PIECE)), lambda i: F.slice(lengths, i, PIECE))

    def joined(p: Column) -> Column:
        wholes = F.transform(p, lambda c: F.aggregate(c, F.lit(0), lambda total, n: add(total, n)))
        return F.flatten(F.zip_with(p, _starts(wholes, levels - 1, add), lambda c, at: F.transform(_starts(c, 0, add), lambda n: add(n, at))))

    return _let(pieces, joined)


def _let(value: Column, then) -> Column:
    """then(value), with value evaluated once."""
    return F.transform(F.array(value), then)[0]


def _placed(x: Column, pattern: str) -> Column:
    """Spans of the matches x.m in x.t: the text between matches and the matches alternate."""

    def spans(y: Column) -> Column:
        lengths = F.zip_with(F.slice(y["g"], 1, F.size(y["m"])), y["m"], lambda gap, m: F.char_length(gap) + F.char_length(m))
        return _let(F.struct(y["m"].alias("m"), y["g"].alias("g"), _let(lengths, lambda n: _starts(n)).alias("at")), fill)

    def fill(z: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            gap = F.get(z["g"], i)
            start = F.get(z["at"], i) + F.char_length(gap)
            before, after = F.right(gap, F.lit(CONTEXT)), F.left(F.get(z["g"], i + 1), F.lit(CONTEXT))
            return F.struct(start.alias("s"), (start + F.char_length(m)).alias("e"), m.alias("m"), before.alias("before"), after.alias("after"))

        return F.transform(z["m"], span)

    split = _let(F.struct(x["m"].alias("m"), F.split(x["t"], pattern, -1).alias("g")), spans)
    return F.when(F.size(x["m"]) > 0, split).otherwise(F.array().cast(SPANS))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether a string's digits pass the Luhn check; false for more of them than any card has."""
    d = F.reverse(digits(m))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 1, F.substr(d, i, F.lit(1)).cast("int")).otherwise(
            (F.substr(d, i, F.lit(1)).cast("int") * 2) - F.when(F.substr(d, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.when(F.length(d).between(1, 24), total % 10 == 0).otherwise(False)


def octets_ok(m: Column) -> Column:
    """Whether each dot-separated number is at most 255 (leading zeros allowed, any length)."""
    return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def base_ok(kind: str, m: Column) -> Column:
    if kind == "ip":
        return octets_ok(m)
    if kind == "card":
        return F.length(digits(m)).between(16, 19) & luhn(m)
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


def features(k: int, s: Column) -> list[Column]:
    """Format and context of a candidate of kind k: numbers, N_FEATURES of them."""
    m, before, after = s["m"], s["before"], s["after"]
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return [
        F.lit(k),
        F.length(digits(m)),
        F.char_length(m),
        flag(luhn(m)) if k == 2 else F.lit(-1),
        flag(octets_ok(m)) if k == 1 else F.lit(-1),
        flag(m.contains("@")),
        flag(m.startswith("+")),
        F.length(F.regexp_replace(m, "[A-Za-z0-9@+]", "")),
        flag(before.rlike(r"[A-Za-z0-9@.+%_\"'=-]$")),
        flag(after.rlike(r"^(?:[A-Za-z0-9@%_\"']|[.-][0-9A-Za-z])")),
        flag(F.lower(before).rlike(r"(?:card|phone|tel|call|mail|mobile|fax|address|contact)")),
        *(_layout(m) if k == 3 else [F.lit(-1)] * 5),
    ]


def _layout(m: Column) -> list[Column]:
    """How a telephone number is written: area code in brackets, kinds of separators after it, groups, leading digits."""
    rest = F.regexp_replace(m, r"^\([0-9]+\) ?", "")
    kinds = [rest.contains(c).cast("int") for c in (" ", ".", "-", "/")]
    return [
        m.startswith("(").cast("int"),
        kinds[0] + kinds[1] + kinds[2] + kinds[3],
        F.size(F.split(m, "[^0-9]+")),
        m.rlike(r"^\(?[2-9][0-9]{2}[) .-]{1,2}[2-9][0-9]{2}[ .-][0-9]{4}$").cast("int"),
        F.when(m.rlike(r"^\(?0[1-9]") & ~m.rlike(r"[.].*[.].*[.]"), 1).otherwise(0),
    ]


def candidates(text: Column) -> dict[str, Column]:
    """Per generator an array of spans: the four base patterns, then the wider nets."""
    has_digit = text.rlike("[0-9]")
    possible = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": has_digit, "phone": text.rlike(r"\+[0-9]")}
    out = {f"base_{k}": _spans(text, BASE[k], possible[k]) for k in KINDS}
    out |= {f"wide_{i}": _spans(text, p, text.rlike(test)) for i, (_, p, test) in enumerate(WIDER)}
    return out


# --- training: small, on the driver -------------------------------------------------------------------------------


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients: (feature, cut, left, right) or a leaf's value."""
    leaf = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 8:
        return leaf
    best, base = (1e-6, None), g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            gl, hl = g[left].sum(), h[left].sum()
            gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - base
            if gain > best[0]:
                best = (gain, (f, float(cut)))
    if best[1] is None:
        return leaf
    f, cut = best[1]
    left = x[:, f] <= cut
    return (f, cut, _tree(x[left], g[left], h[left], depth - 1), _tree(x[~left], g[~left], h[~left], depth - 1))


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, a, b = tree
    return np.where(x[:, f] <= cut, _value(a, x), _value(b, x))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.3) -> list:
    trees, score = [], np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _tree(x, p - y, p * (1 - p), depth)
        trees.append((rate, tree))
        score += rate * _value(tree, x)
    return trees


def _as_case(tree, feature) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, a, b = tree
    return F.when(feature(f) <= cut, _as_case(a, feature)).otherwise(_as_case(b, feature))


class Model:
    """Trees and per-kind thresholds of probability."""

    def __init__(self, trees: list, thresholds: dict[int, float]):
        self.trees, self.thresholds = trees, thresholds

    def probability(self, f: Column) -> Column:
        """f: a struct x0..xn of features."""
        total = F.lit(0.0)
        for rate, tree in self.trees:
            total = total + F.lit(rate) * _as_case(tree, lambda i: f[f"x{i}"])
        return 1 / (1 + F.exp(-total))

    def accepts(self, k: int, f: Column) -> Column:
        return self.probability(f) >= self.thresholds.get(k, 2.0)


def _altered(kind: str, m: str, rnd: random.Random) -> list[tuple[str, int]]:
    """Other writings of a true span (1) and near misses (0)."""
    d = "".join(c for c in m if c.isdigit())
    if kind == "email" and "@" in m:
        return [(m.replace("@", " [at] "), 1), (m.replace("@", "(at)"), 1), (m.split("@")[0] + " [at] " + str(rnd.randrange(99)), 0)]
    if kind == "phone" and len(d) >= 10:
        t = d[-10:]
        a, b, c = str(rnd.randrange(2, 10)) + t[1:3], str(rnd.randrange(2, 10)) + t[4:6], t[6:]
        good = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"]
        z = "0" + str(rnd.randrange(1, 10)) + t[1]
        good += [f"{z} {t[2:6]} {t[6:]}", f"{z} {t[2:9]}", f"{z}-{t[2:9]}", f"{z}/{t[2:9]}", f"({z}) {t[2:9]}", " ".join([z[:2], t[2:4], t[4:6], t[6:8], t[8:]])]
        low = str(rnd.randrange(2))
        bad = [f"{low}{t[1:3]}{s}{b}{s}{c}" for s in " .-"] + [f"{a}{s}{low}{t[4:6]}{s}{c}" for s in " .-"]
        bad += [f"{a}-{b} {c}", f"{a} {b}.{c}", f"{a}.{b}-{c}", f"00{t[1:3]} {t[2:8]}", f"00 {t[2:4]} {t[4:6]} {t[6:8]} {t[8:]}", f"{z}.{t[2:5]}.{t[5:8]}.{t[8:]}", f"{z}-{t[2:5]} {t[5:9]}"]
        return [(x, 1) for x in good] + [(x, 0) for x in bad]
    if kind == "card" and len(d) == 16:
        wrong = d[:-1] + str((int(d[-1]) + rnd.randrange(1, 10)) % 10)
        return [(" ".join(d[i : i + 4] for i in range(0, 16, 4)), 1), (wrong, 0), (d[: rnd.randrange(2, 14)], 0), (d + d[:6], 0)]
    if kind == "ip":
        return [(".".join(str(rnd.randrange(256, 999)) for _ in range(4)), 0), (".".join(str(rnd.randrange(0, 3)) for _ in range(3)), 0)]
    return []


#: Spans of each kind that training starts from beside the corpus's own: without personal data in it the model still stands.
SEEDS = {
    "email": ["jo.doe@mail.example.com", "info@example.org", "a_b@sub.example.net"],
    "ip": ["192.0.2.17", "198.51.100.4", "203.0.113.250"],
    "card": ["4111111111111111", "5500005555555559", "4012888888881881"],
    "phone": ["+1 (212) 555-0147", "+44 20 7946 0958", "+12125550147"],
}


def train(docs: DataFrame, rows: int = 2000, spans: int = 500, longest: int = 320) -> Model:
    """Trees from the base generators' candidates in at most `rows` whole documents, chosen by hash of the id: `spans` of
    a kind at most, chosen by hash wherever they stand in the text, and their altered copies. Candidates of more than
    `longest` characters (no address or number is that long) teach nothing."""
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    taught = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most `rows` ids
    chosen = taught.groupBy("doc_id").agg(F.min("text").alias("text")).where(F.col("text").isNotNull())
    found = candidates(F.col("text"))

    def of_kind(k: int) -> Column:
        return F.transform(found[f"base_{KINDS[k]}"], lambda s: F.struct(F.lit(k).alias("k"), s["m"].alias("m"), s["before"].alias("before"), s["after"].alias("after")))

    every = F.explode(F.concat(*[of_kind(k) for k in range(len(KINDS))]))
    seen = durable(chosen.select(every.alias("c")).select("c.*").where(F.char_length("m") <= longest).distinct(), "taught")
    rnd = random.Random(9)
    lines: list[tuple[int, str, str, str, int]] = []
    for k, kind in enumerate(KINDS):
        picked = seen.where(F.col("k") == k).orderBy(F.xxhash64("m", "before", "after"), "m", "before", "after").limit(spans).collect()
        own = [(r.m, r.before, r.after) for r in picked]
        own += [(m, " see ", " and ") for m in SEEDS[kind]] * 3
        for m, before, after in own:
            lines.append((k, m, before, after, -1))
            lines += [(k, a, before, after, y) for a, y in _altered(kind, m, rnd)]
    discard(seen)
    schema = "k int, m string, before string, after string, y int"
    table = docs.sparkSession.createDataFrame(lines, schema)
    s = F.struct("m", "before", "after")
    by_kind = [F.when(F.col("k") == i, F.array(*[c.cast("double") for c in features(i, s)])) for i in range(len(KINDS))]
    truth = F.coalesce(*[F.when(F.col("k") == i, base_ok(kind, F.col("m"))) for i, kind in enumerate(KINDS)])
    got = table.select(F.coalesce(*by_kind).alias("x"), F.when(F.col("y") >= 0, F.col("y")).otherwise(truth.cast("int")).alias("y"), "k").collect()
    x, y, kind = np.array([r.x for r in got]), np.array([float(r.y) for r in got]), np.array([r.k for r in got])
    part = np.random.default_rng(9).random(len(y)) < 0.7
    trees = boost(x[part], y[part])
    p = 1 / (1 + np.exp(-sum(rate * _value(t, x) for rate, t in trees)))
    return Model(trees, {k: calibrate(p[~part & (kind == k)], y[~part & (kind == k)]) for k in range(len(KINDS))})


def calibrate(p: np.ndarray, y: np.ndarray, precision: float = 0.98) -> float:
    """The least threshold of 0.8 or more at which the precision is reached; none: nothing is added."""
    for t in sorted({0.8, *p[p >= 0.8].tolist()}):
        if (p >= t).any() and y[p >= t].mean() >= precision:
            return max(0.8, float(t))
    return 2.0


# --- detection ----------------------------------------------------------------------------------------------------


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, base, all): arrays of struct<k, s, e> in order, k the place in KINDS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", *[v.alias(n) for n, v in candidates(text).items()])
    span = lambda k, s: F.struct(F.lit(k).alias("k"), s["s"].alias("s"), s["e"].alias("e"))
    base, more = [], []

    def chosen(k: int, spans: Column) -> Column:
        held = F.transform(spans, lambda s: F.struct(s.alias("c"), F.struct(*[c.alias(f"x{i}") for i, c in enumerate(features(k, s))]).alias("f")))
        return F.transform(F.filter(held, lambda h: model.accepts(k, h["f"])), lambda h: span(k, h["c"]))

    def of_kind(k: int, kind: str) -> None:
        spans = F.col(f"base_{kind}")
        good = spans if kind == "email" else F.filter(spans, lambda s: base_ok(kind, s["m"]))
        base.append(F.transform(good, lambda s: span(k, s)))
        if kind != "email":
            more.append(chosen(k, F.filter(spans, lambda s: ~base_ok(kind, s["m"]))))

    for k, kind in enumerate(KINDS):
        of_kind(k, kind)
    for i, (kind, _, _) in enumerate(WIDER):
        more.append(chosen(KINDS.index(kind), F.col(f"wide_{i}")))
    return found.select("doc_id", F.sort_array(F.concat(*base)).alias("base"), F.concat(*more).alias("more")).select(
        "doc_id", "base", F.when(F.size("more") == 0, F.col("base")).otherwise(F.sort_array(F.concat("base", "more"))).alias("all")
    )


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["k"] + 1), s["s"], s["e"])), ",")


def personal_data(docs: DataFrame, rows: int = 2000) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of docs; counts are of base spans."""
    found = detect(docs, train(docs, rows))
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("all")).alias("spans"))


#: Code points of a block, as a power of two: a stretch of text is cut out of the blocks it touches, not out of the whole.
BLOCK_BITS = 8


def masked(text: Column, spans: Column, mark: str = "*") -> Column:
    """text with the code points of spans (array<struct<s: int, e: int>>, which may overlap) masked, one mark each. The cost is
    that of the text and of a block a span."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << BLOCK_BITS}}}"), F.lit(0))

    def stretch(x: Column, a: Column, b: Column) -> Column:
        first, last = F.shiftright(a, BLOCK_BITS), F.shiftright(b - 1, BLOCK_BITS)
        held = F.array_join(F.slice(x["b"], first + 1, last - first + 1), "")
        return F.when(b > a, F.substr(held, a - F.shiftleft(first, BLOCK_BITS) + 1, b - a)).otherwise("")

    def part(x: Column, s: Column, done: Column) -> Column:
        from_ = F.greatest(s["s"], done)
        return F.concat(stretch(x, done, s["s"]), F.when(s["e"] > from_, F.repeat(F.lit(mark), s["e"] - from_)).otherwise(""))

    def joined(x: Column) -> Column:
        done = _starts(F.transform(x["a"], lambda s: s["e"]), add=F.greatest)
        tail = stretch(x, F.array_max(F.transform(x["a"], lambda s: s["e"])), x["n"])
        return F.concat(F.array_join(F.zip_with(x["a"], done, lambda s, d: part(x, s, d)), ""), tail)

    held = F.struct(F.sort_array(spans).alias("a"), blocks.alias("b"), F.char_length(text).alias("n"))
    return F.when(F.size(spans) > 0, _let(held, joined)).otherwise(text)


def redact(docs: DataFrame, model: Model, mark: str = "*") -> DataFrame:
    """docs with every found span masked, character for character; a null text becomes the empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = detect(docs.select(F.struct(*docs.columns).alias("doc_id"), text.alias("text")), model)
    places = F.transform("all", lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e")))
    found = spans.withColumn("masked", masked(F.coalesce(F.col("doc_id.text"), F.lit("")), places, mark))
    return found.select(*[F.col("masked").alias(c) if c.lower() == "text" else F.col(f"doc_id.`{c}`") for c in docs.columns])
