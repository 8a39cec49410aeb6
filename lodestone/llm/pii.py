"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs the labelers, and a
span classifier trained on its posteriors decides. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, unused

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

#: Each pattern starts only where no earlier start of the same run could have matched, and its loops
#: give nothing back, so that a long run of word characters or digits is read once.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": f"(?:(?<!{_LOCAL})|\\G){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9]){11,}+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
    "secret": "(?i)(?:api[_-]?key|secret|token|passw(?:or)?d)[\"']?\\x20{0,3}[:=]\\x20{0,3}[\"']?[A-Za-z0-9+/_=-]{12,}+",
    "local": "(?<![0-9+(.-])(?:\\([0-9]{3}\\)\\x20?|[0-9]{3}[.\\x20-])[0-9]{3}[.\\x20-][0-9]{4}(?![0-9.-])",
}
#: A cheap test that every match of a pattern passes.
_MAY = {"email": ("@",), "phone": ("+",), "ip": (".",), "secret": ("=", ":")}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"

#: The gazetteers.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|de|fr|es|it|uk|eu|us|ch|at|nl|be|ca|au|jp|br|mx|ru|pl|se|no|dk|fi|pt|in|cn"
HINTS = {
    "email": "e-?mail|mail|contact|write|correo|courriel",
    "ip": "\\bip\\b|address|host|server|login|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|cell|whatsapp|telefon|appel|llam",
    "secret": "key|token|secret|passw|auth|bearer|credential",
}
AGAINST = "(?:isbn|issn|doi|version|v\\.|release|build|chapter|section|page|order|invoice|figure|table|http\\S*|#)\\W{0,3}$"
LABELERS = ("format", "check", "gazetteer", "context", "shape")
WINDOW = 40
BLOCK = 256
#: Features of a span for the classifier: how many values each has.
FEATURES = {"length": 6, "classes": 8, "hint": 2}


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _before(items: Column, zero: Column, value, combine) -> Column:
    """For each item what combine makes of the values of all items before it. In blocks, as an array
    grows by being copied: the steps are in proportion to the items."""
    empty = F.slice(F.array(zero), 1, 0)

    def gathered(xs: Column, of) -> Column:
        start = F.struct(zero.alias("t"), empty.alias("out"))
        return F.aggregate(xs, start, lambda a, x: F.struct(combine(a.t, of(x)).alias("t"), F.concat(a.out, F.array(a.t)).alias("out")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
    local = F.transform(blocks, lambda xs: gathered(xs, value))
    bases = lambda own: gathered(own, lambda x: x.t).out
    joined = lambda own: _let(bases(own), lambda base: F.flatten(F.transform(own, lambda x, i: F.transform(x.out, lambda o: combine(F.get(base, i), o)))))
    return F.when(F.size(items) > 0, _let(local, joined)).otherwise(empty)


def _spans(text: Column, pattern: str, may: tuple[str, ...] = ()) -> Column:
    """Array of (s, e, v, before, after) of the leftmost non-overlapping matches: code points, end
    exclusive, and what stands around the match, up to its neighbours."""
    some = F.lit(True)
    if may:
        some = F.lit(False)
        for x in may:
            some = some | F.contains(text, F.lit(x))
    none = F.array().cast("array<struct<s:int,e:int,v:string,before:string,after:string>>")

    def placed(found: Column) -> Column:
        cut = F.transform(F.split(text, pattern), lambda g: F.struct(F.length(g).alias("n"), F.substring(g, F.lit(-WINDOW), F.lit(WINDOW)).alias("end"), F.substring(g, 1, 2).alias("begin")))
        return _let(cut, lambda gaps: joined(found, gaps))

    def joined(found: Column, gaps: Column) -> Column:
        whole = F.transform(found, lambda v, i: F.struct(v.alias("v"), F.length(v).alias("n"), F.get(gaps, i).alias("gap"), F.get(gaps, i + 1).begin.alias("after")))
        return _let(whole, lambda items: _let(_before(items, F.lit(0), lambda x: x.gap.n + x.n, lambda x, y: x + y), lambda at: F.transform(items, lambda x, i: span(x, F.get(at, i) + x.gap.n))))

    def span(x: Column, s: Column) -> Column:
        return F.struct(s.alias("s"), (s + x.n).alias("e"), x.v.alias("v"), F.coalesce(x.gap.end, F.lit("")).alias("before"), F.coalesce(x.after, F.lit("")).alias("after"))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(some, _let(found, lambda f: F.when(F.size(f) == 0, none).otherwise(placed(f)))).otherwise(none)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    digits = F.reverse(_digits(v))
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return total % 10 == 0


def _is_base(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return v.rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$")
    n = F.length(_digits(v))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(v)).otherwise(F.lit(False))
    if kind == "phone":
        return v.startswith("+") & n.between(8, 15)
    return F.lit(False)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, v: Column, before: Column, after: Column) -> dict[str, Column]:
    """Each labeler's vote: 1 personal, -1 not, 0 abstains."""
    digits = _digits(v)
    n = F.length(digits)
    false = F.lit(False)
    if kind == "email":
        fmt = _vote(v.rlike("^[A-Za-z0-9][A-Za-z0-9._%+-]*@"), v.rlike("^[^A-Za-z0-9]|\\.\\.|@-"))
        check = _vote(v.rlike("@[^@]{4,}$"), v.rlike("@[^@]{0,3}$"))
        gaz = _vote(v.rlike(f"(?i)\\.(?:{DOMAINS})$"), ~v.rlike("\\.[A-Za-z]{2,}$"))
    elif kind == "ip":
        fmt = _vote(v.rlike("^[0-9]{1,3}(?:\\.[0-9]{1,3}){3}$"), v.rlike("[0-9]{4}"))
        check = _vote(_is_base(kind, v), ~_is_base(kind, v))
        gaz = _vote(false, v.rlike("^(?:0|127|255)\\."))
    elif kind == "card":
        fmt = _vote(n.between(16, 19), ~n.between(16, 19))
        check = F.when(n.between(12, 19), _vote(_luhn(v), ~_luhn(v))).otherwise(F.lit(-1))
        gaz = _vote(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), digits.rlike("^[01]"))
    elif kind == "phone":
        fmt = _vote(n.between(8, 15), ~n.between(8, 15))
        check = _vote(v.rlike("^\\+|^\\("), false)
        gaz = _vote(digits.rlike("^(?:1|33|34|44|49|39|41|43|31|32)[2-9]"), digits.rlike("^0000"))
    else:
        own = F.regexp_extract(v, "[A-Za-z0-9+/_=-]+$", 0)
        kinds = F.size(F.array_distinct(F.split(own, "")))
        fmt = _vote(own.rlike("^(?:[0-9a-f]{16,}|[A-Za-z0-9+/_-]{20,}=*)$"), F.length(own) < 16)
        check = _vote(kinds >= 10, kinds < 6)
        gaz = _vote(v.rlike("(?i)^(?:api|secret|token|passw)"), own.rlike("(?i)example|changeme|your"))
    context = _vote(before.rlike(f"(?i)(?:{HINTS[kind]})"), before.rlike(f"(?i){AGAINST}"))
    odd = v.rlike("(?:([0-9A-Za-z])\\1{5,})|0123456|1234567") | after.rlike("^[0-9A-Za-z]")
    shape = _vote(~odd & (before.rlike("(?:^|[\\s(\"'<:=,;])$") | (F.length(before) == 0)), odd)
    return dict(zip(LABELERS, (fmt, check, gaz, context, shape)))


def candidates(text: Column) -> Column:
    """Array of all candidate spans: (k: place of the kind, s, e, base, votes)."""
    parts = []
    for k, kind in enumerate(KINDS):
        patterns = [kind, "local"] if kind == "phone" else [kind]
        for name in patterns:
            spans = _spans(text, PATTERNS[name], _MAY.get(name, ()))

            def rated(x: Column, kind: str = kind, k: int = k) -> Column:
                votes = _votes(kind, x.v, x.before, x.after)
                traits = _features(kind, x.v, x.before)
                return F.struct(
                    F.lit(k).alias("k"), x.s.alias("s"), x.e.alias("e"), _is_base(kind, x.v).alias("base"),
                    F.struct(*(c.cast("int").alias(n) for n, c in votes.items())).alias("votes"), F.struct(*(c.cast("int").alias(n) for n, c in traits.items())).alias("traits"),
                )

            if kind == "card":
                spans = F.filter(spans, lambda x: F.length(x.v) < 40)  # longer ones have more than 19 digits
            parts.append(F.transform(spans, _one_argument(rated)))
    return F.concat(*parts)


def _features(kind: str, v: Column, before: Column) -> dict[str, Column]:
    """What the classifier sees of a span itself: its length, which sorts of characters it has, and
    whether a word nearby names its kind."""
    classes = F.when(v.rlike("[0-9]"), 1).otherwise(0) + F.when(v.rlike("[a-z]"), 2).otherwise(0) + F.when(v.rlike("[A-Z]"), 4).otherwise(0)
    return {"length": F.least(F.floor(F.length(v) / 8), F.lit(FEATURES["length"] - 1)), "classes": classes, "hint": before.rlike(f"(?i)(?:{HINTS[kind]})").cast("int")}


def _one_argument(f):
    return lambda x: f(x)


def fit_labelers(patterns: list[tuple[int, tuple[int, ...], float]], rounds: int = 30) -> tuple[dict, dict]:
    """Expectation-maximisation over vote patterns (kind, votes, count).

    Labelers are independent given the hidden class; each has a chance of every vote under both
    classes. Returns posteriors by (kind, votes), and reliabilities: the labelers' chance to vote for
    the hidden class where they vote. The table has at most kinds * 3 ** labelers rows."""
    post = {(k, v): 1 / (1 + math.exp(-1.5 * sum(v))) for k, v, _ in patterns}
    m = len(LABELERS)
    rates: dict = {}
    for _ in range(rounds):
        rates = {(j, c, x): 1.0 for j in range(m) for c in (0, 1) for x in (-1, 0, 1)}
        prior: dict = {}
        for k, v, n in patterns:
            p = post[k, v]
            a, b = prior.get(k, (1.0, 1.0))
            prior[k] = (a + n * p, b + n * (1 - p))
            for j, x in enumerate(v):
                rates[j, 1, x] += n * p
                rates[j, 0, x] += n * (1 - p)
        sums = {(j, c): sum(rates[j, c, x] for x in (-1, 0, 1)) for j in range(m) for c in (0, 1)}
        for k, v, _ in patterns:
            score = math.log(prior[k][0] / prior[k][1])
            for j, x in enumerate(v):
                if x:  # abstaining says nothing
                    score += math.log(rates[j, 1, x] / sums[j, 1]) - math.log(rates[j, 0, x] / sums[j, 0])
            post[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
    reliable = {
        LABELERS[j]: (rates[j, 1, 1] + rates[j, 0, -1]) / max(1e-9, sum(rates[j, c, x] for c in (0, 1) for x in (-1, 1)))
        for j in range(m)
    } if rates else {}
    return post, reliable


def train_classifier(patterns: list[tuple[int, tuple[int, ...], tuple[int, ...], float]], post: dict, steps: int = 300) -> dict:
    """Logistic regression on the posteriors, by gradient steps over the table of (kind, votes, features,
    count): a bias by kind, a weight by labeler and vote, and one by kind, feature and value."""
    weights: dict = {}
    total = sum(n for *_, n in patterns) or 1.0
    keys = [[("kind", k), *((j, x) for j, x in enumerate(v) if x), *((k, name, x) for name, x in zip(FEATURES, f))] for k, v, f, _ in patterns]
    for _ in range(steps):
        grad: dict = {}
        for (k, v, _, n), own in zip(patterns, keys):
            z = sum(weights.get(f, 0.0) for f in own)
            miss = n / total * (post[k, v] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            for f in own:
                grad[f] = grad.get(f, 0.0) + miss
        for f, g in grad.items():
            weights[f] = weights.get(f, 0.0) * 0.9995 + 4.0 * g
    return weights


def _score(x: Column, weights: dict) -> Column:
    def weight(at: Column, keys: list) -> Column:
        return F.get(F.array(*(F.lit(float(weights.get(key, 0.0))) for key in keys)), at)

    kinds = range(len(KINDS))
    z = weight(x.k, [("kind", k) for k in kinds])
    for j, name in enumerate(LABELERS):
        z = z + weight(x.votes[name] + 1, [(j, -1), ("none", j), (j, 1)])
    for name, values in FEATURES.items():
        z = z + weight(x.k * values + x.traits[name], [(k, name, value) for k in kinds for value in range(values)])
    return z


def find_spans(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs' columns but the text, and spans: array of (k, s, e, base) by kind and start. Every base
    match is a span; another candidate is one if the classifier's chance is above the threshold, and it
    overlaps no base match and no such candidate that starts before it. Null text has no span, rows are
    taken one by one, and other columns pass through (one named spans is replaced).

    The text is read once, in steps that grow with its length: candidates go to a table in the shared
    folder, their patterns of votes and features are counted there (a table of bounded size), and the
    fitted weights are literals in the last step."""
    others = [c for c in docs.columns if c not in (text, "spans")]
    whole_, found_ = unused(others, "text", "c")
    whole = docs.select(*(F.col(f"`{c}`") for c in others), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(whole_))
    found, _ = materialize(whole.select(*(F.col(f"`{c}`") for c in others), candidates(F.col(whole_)).alias(found_)), "candidates")
    counted = found.where(F.size(found_) > 0).select(F.explode(found_).alias("c")).groupBy("c.k", "c.votes", "c.traits").count()
    patterns = sorted((r["k"], tuple(r["votes"]), tuple(r["traits"]), float(r["count"])) for r in counted.collect())
    votes: dict = {}
    for k, v, _, n in patterns:
        votes[k, v] = votes.get((k, v), 0.0) + n
    post, _ = fit_labelers([(k, v, n) for (k, v), n in votes.items()])
    weights = train_classifier(patterns, post)
    bar = math.log(threshold / (1 - threshold))
    slim = lambda x: F.struct(x.k.alias("k"), x.s.alias("s"), x.e.alias("e"), x.base.alias("base"))
    far = F.lit(2**31 - 1)

    def chosen(c: Column) -> Column:
        taken = F.transform(F.filter(c, lambda x: x.base | (_score(x, weights) > bar)), lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.k.alias("k"), x.base.alias("base")))
        return F.array_sort(_let(F.array_sort(taken), apart))

    def apart(sorted_: Column) -> Column:
        """Base matches, and the others that no earlier span reaches into and that reach into no base match."""
        ends = _before(sorted_, F.lit(0), lambda x: x.e, F.greatest)
        starts = _before(F.reverse(sorted_), far, lambda x: F.when(x.base, x.s).otherwise(far), F.least)
        both = lambda end: _let(F.reverse(starts), lambda start: F.filter(F.transform(sorted_, lambda x, i: F.when(x.base | ((F.get(end, i) <= x.s) & (F.get(start, i) >= x.e)), slim(x))), lambda x: x.isNotNull()))
        return F.when(F.exists(sorted_, lambda x: ~x.base), _let(ends, both)).otherwise(F.transform(sorted_, slim))

    return found.select(*(F.col(f"`{c}`") for c in others), F.when(F.size(found_) > 0, chosen(F.col(found_))).otherwise(F.transform(found_, slim)).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.k), x.s, x.e)), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' spans. Null, empty and clean texts have zero counts and empty strings."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_spans(docs)
    base = F.filter("spans", lambda x: x.base)
    counts = [F.size(F.filter("spans", _one_argument(lambda x, k=k: x.base & (x.k == k)))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets."""
    marked = find_spans(docs.withColumn("__whole", F.col(text)), text)
    names = F.array(*(F.lit(k) for k in KINDS))
    spans = F.array_sort(F.transform("spans", lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.k.alias("k"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        kept = F.substring(F.col("__whole"), a["at"] + 1, F.greatest(x.s - a["at"], F.lit(0)))
        return F.struct(F.greatest(a["at"], x.e).alias("at"), F.concat(a.out, kept, F.lit("<"), F.get(names, x.k), F.lit(">")).alias("out"))

    clean = F.aggregate(spans, start, step, lambda a: F.concat(a.out, F.substring(F.col("__whole"), a["at"] + 1, F.length("__whole"))))
    return marked.withColumn(text, clean).select(docs.columns)
