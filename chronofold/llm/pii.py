"""Personal data by weak supervision. DataFrame and SQL functions only.

Candidates are the base matches of four kinds (email, ip, card, phone) and looser spellings of the same kinds ("jo at host dot org",
defanged and IPv6 addresses, cards with other separators, telephone numbers without a plus sign), and, as evidence against, the matches of both that
fail the checks of their kind (octets, Luhn, digit counts). Labelers vote 1, -1 or 0 on each: the spelling; the checks; a gazetteer (top-level domains, card issuers, calling and area codes, reserved address blocks); words
of the context that speak for and against; the characters at both ends. Expectation-maximisation over the counts of vote patterns
estimates each labeler's reliability per kind, with its posteriors as soft labels a logistic regression over the votes and features of the
span is trained, and it decides on the loose candidates that pass the checks. Base spans always stay; a loose one that overlaps a base span goes.

One pass over the texts writes each row's candidates. The driver gets counts of patterns of votes and features: no more than
4 * 3**6 * 2**6 rows by construction, of which few occur, whatever the size of the corpus.

Matches: `split` gives what lies between matches and `regexp_extract_all` the matches, so lengths give the places in code points.
The patterns find what the contract's find, but cannot backtrack into a repetition: linear time and flat stack on very long texts.

Nulls: a null text is empty and has no spans. Repeated rows stay. Empty tables give empty results. Columns besides doc_id and text
are ignored by the query and kept by redact().
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, table

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns with possessive repetitions. A run of letters is entered at its start or where the last match ended only.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?[(\[]at[)\]] ?| at | AT )[A-Za-z0-9-]{1,63}+(?:(?: ?[(\[]dot[)\]] ?| dot | DOT )[A-Za-z0-9-]{2,63}+){1,6}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}+|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}+(?:(?:[._/]|  | - )[0-9]{4}+){3}+(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: What a text with a match holds; looked for before the pattern is.
HINTS = {("strict", "email"): ["@"], ("strict", "phone"): ["+"], ("loose", "email"): ["dot", "DOT"], ("loose", "ip"): ["[.]", ":"]}
#: Fixed word lists of the gazetteer and context labelers.
DOMAINS = "com org net edu gov io info biz co uk de fr es it nl eu us ca au jp cn in br ch at be se no".split()
FOR = {
    "email": "mail e-mail contact write reach address correo courriel adresse".split(),
    "ip": "ip host server address client login from addr".split(),
    "card": "card visa mastercard amex credit debit tarjeta carte karte payment".split(),
    "phone": "call phone tel fax mobile cell ring whatsapp text telefon llame appelez".split(),
}
AGAINST = "version build isbn issn sku token commit order invoice part model serial chapter section".split()
VOTES = ("spelling", "checks", "gazetteer", "context", "against", "ends")
FEATURES = ("long", "separated", "digits", "upper", "repeated", "later")


def _spans(text: str, pattern: str, kind: int, loose: int, hints: list[str] | None) -> str:
    """SQL: an array of struct<s, k, e, l, v> of all matches, empty where a hint is missing."""
    quoted = "r'" + pattern.replace("'", "''") + "'"
    empty = "cast(array() as array<struct<s:int,k:int,e:int,l:int,v:string>>)"
    place = f"""aggregate(sequence(1, size(m)), named_struct('p', 0, 'o', {empty}),
        (a, i) -> named_struct('p', a.p + char_length(g[i - 1]) + char_length(m[i - 1]), 'o', concat(a.o, array(named_struct(
            's', a.p + char_length(g[i - 1]), 'k', {kind}, 'e', a.p + char_length(g[i - 1]) + char_length(m[i - 1]), 'l', {loose}, 'v', m[i - 1])))), a -> a.o)"""
    found = f"element_at(transform(array(regexp_extract_all({text}, {quoted}, 0)), m -> if(size(m) = 0, {empty}, element_at(transform(array(split({text}, {quoted}, -1)), g -> {place}), 1))), 1)"
    return found if not hints else f"if({' or '.join(f'''contains({text}, '{h}')''' for h in hints)}, {found}, {empty})"


def _luhn(digits: str) -> str:
    doubled = f"cast(substring({digits}, i, 1) as int) * if((char_length({digits}) - i) % 2 = 1, 2, 1)"
    return f"aggregate(sequence(1, char_length({digits})), 0, (a, i) -> a + if({doubled} > 9, {doubled} - 9, {doubled})) % 10 = 0"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _valid() -> str:
    """SQL over span x: the contract's checks by kind."""
    part = "ltrim('0', p)"
    return f"""case x.k when 0 then true
        when 1 then if(x.l = 1 and contains(x.v, ':'), true, forall(split(replace(replace(x.v, '[', ''), ']', ''), '[.]'), p -> char_length({part}) <= 3 and coalesce(try_cast({part} as int), 0) <= 255))
        when 2 then char_length({_digits('x.v')}) between 14 and 19 and {_luhn(_digits('x.v'))}
        else char_length({_digits('x.v')}) between 10 and 15 end"""


def _labelled() -> str:
    """SQL over span x and texts b (before) and a (the character after): the span with its votes and features."""
    digits = _digits("x.v")
    words = " ".join(AGAINST).split()
    known = f"""case x.k
        when 0 then lower(regexp_extract(x.v, '([A-Za-z0-9-]+)$', 1)) in ({', '.join(map(repr, DOMAINS))})
        when 1 then not (x.v rlike '^(0|127|255)[.\\\\[]')
        when 2 then {digits} rlike '^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)'
        else {digits} rlike '^(1|[2-9][0-9])' end"""
    context = " ".join(f"when {k} then b rlike '(?i)\\\\b({'|'.join(FOR[n])})s?\\\\b'" for k, n in enumerate(KINDS))
    return f"""named_struct('s', x.s, 'k', x.k, 'e', x.e, 'l', x.l,
        'spelling', if(x.l = 0, 1, 0), 'checks', if(x.c, 1, -1),
        'gazetteer', if({known}, 1, -1),
        'context', if(case x.k {context} end, 1, 0),
        'against', if(b rlike '(?i)\\\\b({'|'.join(words)})s?\\\\b', -1, 0),
        'ends', if(right(b, 1) rlike '[\\\\p{{L}}\\\\p{{N}}_]' or a rlike '[\\\\p{{L}}\\\\p{{N}}_]', -1, 1),
        'long', cast(x.e - x.s > 16 as int), 'separated', cast(x.v rlike '[ ()-]' as int), 'digits', cast(char_length({digits}) * 2 >= x.e - x.s as int),
        'upper', cast(x.v rlike '[A-Z]' as int), 'repeated', cast(x.v rlike '([0-9])\\\\1\\\\1\\\\1' as int), 'later', cast(x.s >= 1000 as int))"""


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, `base` (spans that always stay, by start, then kind) and `candidates` (every span with votes and features)."""
    made = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t"))
    strict = ", ".join(_spans("__t", STRICT[n], k, 0, HINTS.get(("strict", n))) for k, n in enumerate(KINDS))
    loose = ", ".join(_spans("__t", LOOSE[n], k, 1, HINTS.get(("loose", n))) for k, n in enumerate(KINDS))
    ids = made.columns[:-1]
    found = made.select(*ids, "__t", F.expr(f"transform(concat({strict}, {loose}), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'l', x.l, 'v', x.v, 'c', {_valid()}))").alias("all"))
    parted = found.select(*ids, "__t", F.expr("array_sort(filter(all, x -> x.l = 0 and x.c))").alias("base"), F.expr("filter(all, x -> x.l = 1 or not x.c)").alias("more"))
    apart = parted.select(*ids, "__t", "base", F.expr("filter(more, x -> not exists(base, y -> y.s < x.e and x.s < y.e))").alias("more"))
    around = "element_at(transform(array(named_struct('b', substring(__t, greatest(1, x.s - 31), least(32, x.s)), 'a', substring(__t, x.e + 1, 1))), w -> {}), 1)"
    label = around.format(_labelled().replace("right(b, 1)", "right(w.b, 1)").replace(" b rlike", " w.b rlike").replace("if(b rlike", "if(w.b rlike").replace(" a rlike", " w.a rlike"))
    return apart.select(*[F.col(i).alias(c) for i, c in zip(ids, keep)], "base", F.expr(f"array_sort(transform(concat(base, more), x -> {label}))").alias("candidates"))


@dataclass
class SpanModel:
    """Log-odds of a span: bias of its kind plus weights of votes and features; and what expectation-maximisation found."""

    bias: list[float] = field(default_factory=lambda: [0.0] * len(KINDS))
    weights: dict[str, float] = field(default_factory=dict)
    reliability: dict[tuple[str, str], float] = field(default_factory=dict)
    threshold: float = 0.5

    def accepts(self, x: str) -> str:
        """SQL: whether the labelled span x is personal data."""
        terms = " + ".join(f"{w!r}D * {x}.{n}" for n, w in self.weights.items()) or "0D"
        bias = " ".join(f"when {k} then {b!r}D" for k, b in enumerate(self.bias))
        return f"(case {x}.k {bias} end + {terms} >= {math.log(self.threshold / (1 - self.threshold))!r}D)"


def expectation_maximisation(counts: dict[tuple, float], rounds: int = 60) -> tuple[dict[tuple, float], dict[tuple, float]]:
    """counts: (kind, votes) -> n. Gives (posterior of each pattern, P(vote | class) by (kind, labeler, class, vote))."""
    values = (-1, 0, 1)
    post = {p: 1 / (1 + math.exp(-2.0 * (sum(p[1]) - 0.5))) for p in counts}
    chance: dict[tuple, float] = {}
    for _ in range(rounds):
        for kind in {p[0] for p in counts}:
            own = [(p, n) for p, n in counts.items() if p[0] == kind]
            mass = {1: sum(n * post[p] for p, n in own), 0: sum(n * (1 - post[p]) for p, n in own)}
            for j, y, v in itertools.product(range(len(VOTES)), (0, 1), values):
                hit = sum(n * (post[p] if y else 1 - post[p]) for p, n in own if p[1][j] == v)
                # Pseudo-counts: a labeler is right more often than wrong until the data say otherwise.
                lean = 2.0 if v == (1 if y else -1) else 0.5 if v else 1.0
                chance[kind, j, y, v] = (hit + lean) / (mass[y] + 3.5)
            prior = (mass[1] + 1) / (mass[0] + mass[1] + 2)
            for p, _ in own:
                odds = math.log(prior / (1 - prior)) + sum(math.log(chance[kind, j, 1, v] / chance[kind, j, 0, v]) for j, v in enumerate(p[1]))
                post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, chance


def train(found: DataFrame) -> SpanModel:
    """found: what candidates() gives. Only counts of patterns come to the driver."""
    names = (*VOTES, *FEATURES)
    spans = found.select(F.explode("candidates").alias("x")).select("x.k", *[f"x.{n}" for n in names])
    rows = spans.groupBy("k", *names).count().collect()
    counts: dict[tuple, float] = {}
    for r in rows:
        p = (r.k, tuple(r[n] for n in VOTES))
        counts[p] = counts.get(p, 0) + r["count"]
    model = SpanModel()
    if not counts:
        return model
    post, chance = expectation_maximisation(counts)
    for (kind, j, y, v), c in chance.items():
        if y == 1 and v == 1 or y == 0 and v == -1:
            model.reliability[KINDS[kind], f"{VOTES[j]}{'+' if v == 1 else '-'}"] = c
    total = sum(counts.values())
    # Patterns weigh by the square root of their counts, so that rare loose spellings have a say.
    data = [(r.k, [float(r[n]) for n in names], post[r.k, tuple(r[n] for n in VOTES)], math.sqrt(r["count"] / total)) for r in sorted(rows, key=lambda r: tuple(r[n] for n in ("k", *names)))]
    whole = sum(d[3] for d in data)
    weights, bias = [0.0] * len(names), [0.0] * len(KINDS)
    for step in range(400):
        grad, gbias = [0.0] * len(names), [0.0] * len(KINDS)
        for k, x, y, n in data:
            z = bias[k] + sum(w * v for w, v in zip(weights, x))
            d = n / whole * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
            gbias[k] += d
            for j, v in enumerate(x):
                grad[j] += d * v
        weights = [w - 1.0 * (g + 0.002 * w) for w, g in zip(weights, grad)]
        bias = [b - 1.0 * (g + 0.002 * b) for b, g in zip(bias, gbias)]
    model.weights, model.bias = dict(zip(names, weights)), bias
    return model


def decided(found: DataFrame, model: SpanModel) -> DataFrame:
    """found with `spans`: base spans and accepted loose ones, by start, then kind."""
    loose = F.expr(f"transform(filter(candidates, x -> x.l = 1 and x.checks = 1 and {model.accepts('x')}), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))")
    base = F.expr("transform(base, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))")
    return found.withColumn("base", base).withColumn("spans", F.array_sort(F.concat(base, loose)))


def joined(spans: str) -> Column:
    names = " ".join(f"when {k} then '{n}'" for k, n in enumerate(KINDS))
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', case x.k {names} end, x.s, x.e)), ',')")


def redact(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """docs, all columns, with every span of `text` replaced by its kind in angle brackets; overlapping spans become one mark.

    A null text stays null. Without a model one is trained on docs.
    """
    own = [c for c in docs.columns if c.lower() != "text"]
    text = next(c for c in docs.columns if c.lower() == "text")
    kept = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text}`").alias("text"))
    ids = [f"c{k}" for k in range(len(own))]
    found = candidates(kept, [*own, "text"]).toDF(*ids, "text", "base", "candidates")
    if model is None:  # the spans are looked for once, and stand beside the texts from then on
        found = materialize(found, "pii-candidates")
        model = train(found)
    plain = decided(found, model)
    names = " ".join(f"when {k} then '<{n}>'" for k, n in enumerate(KINDS))
    new = f"""if(size(spans) = 0, text, aggregate(spans, named_struct('p', 0, 'o', cast(array() as array<string>)),
        (a, x) -> if(x.s < a.p, named_struct('p', greatest(a.p, x.e), 'o', a.o), named_struct('p', x.e, 'o', concat(a.o, array(substring(text, a.p + 1, x.s - a.p), case x.k {names} end)))),
        a -> concat(array_join(a.o, ''), substring(text, a.p + 1))))"""
    done = plain.select(*ids, F.expr(new).alias("text"))
    back = dict(zip(own, ids)) | {text: "text"}
    return done.select(*[F.col(back[c]).alias(c) for c in docs.columns])


def op5_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(candidates(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]), "pii-candidates")
    done = decided(found, train(found))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) as bigint)").alias(f"n_{n}") for k, n in enumerate(KINDS)]
    return done.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op5_pii_weak_supervision": op5_pii_weak_supervision}
ORACLE_SQL: dict[str, str] = {}
