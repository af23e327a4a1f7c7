"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from strict patterns (the base: e-mail, IP, card, phone) and from
looser ones (spelled-out e-mails, IPv6, dotted cards, phones without a plus).
Five labelers vote yes, vote no or abstain on each:

* strict: yes for a strict match, silent on a loose one;
* valid: ranges, Luhn and digit counts; of loose ones the form of the last label,
  of the groups or of the number plan;
* known, a gazetteer: top-level domains, issuer prefixes, calling codes (an unknown
  calling code and an IPv6 address leave it silent);
* told, the context: yes after a telling word in the 40 characters before, no right
  after a word that numbers something else (build, part no, order ...), else silent;
* clear: yes where white space or punctuation is on both sides, no where letters,
  digits or signs of code touch the span.

Votes are counted over the whole corpus together with two span features, length
and share of digits in four steps each: at most 4 x 2^14 counts, whatever the corpus.
Expectation-maximisation (Dawid and Skene 1979, with abstentions) estimates the share
of true candidates and each labeler's reliabilities for every kind, strict and
loose apart, from prior pseudo-counts (of loose ones not far from them); then a logistic span classifier for each
of these groups is fitted to the posteriors over votes and features, drawn to the
labelers' own weights by a ridge, so that few candidates cannot move it far.
Spans of the base always stay; a looser candidate is added if it overlaps none
of them and the classifier gives it a probability of one half or more. A match
of a strict pattern that fails its check is evidence for the fit, never a span.

Everything that touches a text happens inside its row, so no key can be hot; what
is shuffled is one count per vote pattern and task. Work within a text is near linear in
its spans.

The patterns are the contract's, with possessive quantifiers and a guard on where
a run may begin: the same matches, in linear time and constant stack on any text.

Edge cases: a null or empty text has no spans; repeated rows are treated one by
one; equal starts cannot occur within a kind; an empty table gives an empty
result and a model of the priors alone; extra columns pass through ``redact``.
Positions count code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statflow.plans.durable import materialize
from statflow.llm.text import let, text_of

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 40
_LOCAL = "A-Za-z0-9._%+-"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: kind -> (strict pattern, cheap test that a text may hold one).
STRICT = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]+\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
LOOSE = {
    "email": (
        rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
        r"[\[(]at[\])]",
    ),
    "ip": (r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    "card": (r"(?<![0-9.])[0-9]{4}\.[0-9]{4}\.[0-9]{4}\.[0-9]{4}(?![0-9.])", r"[0-9]{4}\.[0-9]{4}\.[0-9]{4}"),
    "phone": (r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"),
}
#: Of loose matches.
LOOSE_VALID = {
    "email": r"[A-Za-z]{2,}$",
    "ip": r"(?:[0-9A-Fa-f]{3,4}|[A-Fa-f])",
    "phone": r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]",
}
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|int|info|biz|io|de|fr|es|uk|eu|it|nl|ch|at|be|ru|cn|jp|br|mx|ca|au)$",
    "ip": r"^(?!0|127\.|255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+?(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]|\(?[2-9][0-9]{2})",
}
TELLING = {
    "email": r"(?i)(?:e-?mail|correo|contact|courriel|write to|kontakt|address)",
    "ip": r"(?i)(?:\bip\b|host|server|client|addr|login|adresse)",
    "card": r"(?i)(?:card|visa|master|credit|amex|karte|carte|tarjeta|payment)",
    "phone": r"(?i)(?:phone|\btel|call|mobile|fax|telefon|whatsapp|contact)",
}


#: Names of other numbers, right before the span.
OTHER = (
    r"(?i)\b(?:build|rev(?:ision)?|ver(?:sion)?|v|part|serial|model|sku|isbn|issn|doi|ref(?:erence)?|order|invoice|item|art|id|no|nr|num(?:ber)?|fig(?:ure)?|eq|sec(?:tion)?|ch(?:apter)?|page|pp?"
    r"|vol(?:ume)?|line|lot|case|docket|room|score|ratio|size|release|patch|firmware|ticket|bug|issue|commit|hash|row|code)\b[\x20.:#=-]*(?:(?:no|nr|number|id)\b)?[\x20.:#=-]*$"
)
COUNTER = {"email": r"(?!)", "ip": OTHER, "card": OTHER, "phone": OTHER}
CODE = r"[A-Za-z0-9_#$%=/\\@&*]"
BEFORE, AFTER = r"^[\s(\[{<'\",;:]?$", r"^[\s)\]}>'\",;:.!?]?$"


def running(values: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b, first: int = 0, chunk: int = 128) -> Column:
    """What ``join`` makes of ``first`` and all values before each place of an int array, by chunks, so that long
    arrays stay near linear. ``join`` is associative, ``first`` changes nothing."""
    add = lambda x: F.aggregate(x, F.lit(first), lambda a, b: join(a, b))

    def of(v: Column) -> Column:
        n = F.size(v)
        chunks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), lambda c: F.slice(v, c * chunk + 1, F.lit(chunk)))).otherwise(
            F.array().cast("array<array<int>>")
        )

        def whole(cs: Column) -> Column:
            sums = F.transform(cs, add)
            each = lambda s: F.flatten(
                F.transform(cs, lambda c, k: let(add(F.slice(s, F.lit(1), k)), lambda base: F.transform(c, lambda _, i: join(base, add(F.slice(c, F.lit(1), i))))))
            )
            return let(sums, each)

        return let(chunks, whole)

    return let(values, of)


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "phone":
        return F.length(digits).between(9, 15)

    def luhn(d: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            x = F.substring(d, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return total + F.when(x > 9, x - 9).otherwise(x)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0

    return let(digits, lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))


def _found(text: Column, kind: str, strict: bool) -> Column:
    """Array of (k, s, e, strict, valid, vote), in order of s."""
    pattern, test = (STRICT if strict else LOOSE)[kind]

    def build(pieces: Column, matches: Column) -> Column:
        step = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))

        def row(at: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = F.get(at, i) + F.length(F.get(pieces, i))
                before, left, right = F.right(F.get(pieces, i), F.lit(CONTEXT)), F.right(F.get(pieces, i), F.lit(1)), F.left(F.get(pieces, i + 1), F.lit(1))

                def build(valid: Column) -> Column:
                    return F.struct(
                        F.lit(KINDS.index(kind)).alias("k"), start.alias("s"), (start + F.length(m)).alias("e"), F.lit(strict).alias("strict"), valid.alias("valid"),
                        _vote(kind, strict, valid, m, before, left, right).alias("vote"),
                    )

                return let(_valid(kind, m) if strict or kind == "card" else m.rlike(LOOSE_VALID[kind]), build)

            return F.transform(matches, one)

        return let(running(step), row)

    got = let(F.split(text, pattern, -1), lambda pieces: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda matches: build(pieces, matches)))
    return F.when(text.rlike(test), got).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<k:int,s:int,e:int,strict:boolean,valid:boolean,vote:int>>"
#: Bits of a vote: a yes of the first four labelers, their abstentions, no and yes of the fifth, two span features of two bits.
LABELERS = ("strict", "valid", "known", "told", "clear")
STRICT_BIT, LOOSE_BIT = 1, 1 << 4


def _vote(kind: str, strict: bool, valid: Column, m: Column, before: Column, left: Column, right: Column) -> Column:
    bit = lambda yes, n: F.when(yes, 1 << n).otherwise(0)
    known, told = m.rlike(GAZETTEER[kind]), before.rlike(TELLING[kind])
    silent = ~known if kind == "phone" else F.lit(kind == "ip" and not strict)
    touched = left.rlike(CODE) | right.rlike(CODE)
    digits = F.length(F.regexp_replace(m, "[^0-9]+", ""))
    step = lambda x, cuts: sum(F.when(x >= c, 1).otherwise(0) for c in cuts)
    votes = F.lit(STRICT_BIT if strict else LOOSE_BIT) + bit(valid, 1) + bit(known & ~silent, 2) + bit(silent, 6) + bit(told, 3) + bit(~told & ~before.rlike(COUNTER[kind]), 7)
    votes += bit(touched, 8) + bit(~touched & left.rlike(BEFORE) & right.rlike(AFTER), 9)
    return (votes + step(F.length(m), (10, 16, 30)) * (1 << 10) + step(digits * 4, (F.length(m), F.length(m) * 2, F.length(m) * 3)) * (1 << 12)).cast("int")


def candidates(text: Column) -> Column:
    """All candidates of a text, loose ones only where they overlap no valid strict one."""

    def of(t: Column) -> Column:
        strict = F.concat(*[_found(t, k, True) for k in KINDS])
        loose = F.concat(*[_found(t, k, False) for k in KINDS])

        def free(a: Column) -> Column:
            """Loose ones in order of start: none before reaches into them, none after begins in them."""
            sure = lambda x: x["strict"] & x["valid"]
            mixed = F.array_sort(F.transform(F.concat(F.filter(a, sure), loose), lambda x: F.struct(x["s"].alias("at"), x.alias("x"))))

            def pick(o: Column) -> Column:
                reach = running(F.transform(o, lambda y: F.when(sure(y["x"]), y["x"]["e"]).otherwise(0)), F.greatest)
                ahead = F.reverse(running(F.transform(F.reverse(o), lambda y: F.when(sure(y["x"]), y["at"]).otherwise(FAR)), F.least, FAR))
                return let(reach, lambda r: let(ahead, lambda h: F.filter(o, lambda y, i: ~y["x"]["strict"] & (F.get(r, i) <= y["at"]) & (F.get(h, i) >= y["x"]["e"]))))

            kept = F.transform(let(mixed, pick), lambda y: y["x"])
            return F.when(F.size(loose) > 0, F.concat(a, kept)).otherwise(a)

        return let(strict, free)

    return let(text, of)


FAR = 2**31 - 1


#: Prior chances of a yes, where a labeler votes, on what is and is not personal data: of strict
#: candidates, and by kind of loose ones, where estimates stay within TRUST of them. Most loose matches look
#: valid, so left to itself the latent class would be any other thing that divides them.
_STRICT = ((0.9, 0.9, 0.9, 0.9, 0.95), (0.1, 0.1, 0.4, 0.2, 0.5))
_LOOSE = [((0.5, v, 0.9, 0.95, 0.95), (0.5, f, g, 0.05, 0.8)) for v, f, g in ((0.95, 0.6, 0.5), (0.9, 0.5, 0.8), (0.95, 0.1, 0.5), (0.9, 0.7, 0.8))]
PRIOR = {(k, x): _LOOSE[k] if x else _STRICT for k in range(len(KINDS)) for x in (False, True)}
SHARE = {(k, x): (0.8, 0.5, 0.3, 0.3)[k] if x else 0.5 for k in range(len(KINDS)) for x in (False, True)}
TRUST = 0.08
STRENGTH = 20.0
RIDGE = 10.0


def _votes(vote: int) -> list[int]:
    """Per labeler 1 (yes), -1 (no) or 0."""
    first = [0 if vote >> (4 + i) & 1 else 1 if vote >> i & 1 else -1 for i in range(4)]
    return [*first, 1 if vote >> 9 & 1 else -1 if vote >> 8 & 1 else 0]


def _features(vote: int) -> list[float]:
    """Bias, yes and no of each labeler, steps of length and of the share of digits."""
    votes = _votes(vote)
    return [1.0, *(float(v > 0) for v in votes), *(float(v < 0) for v in votes), *(float(vote >> 10 & 3 == k) for k in range(4)), *(float(vote >> 12 & 3 == k) for k in range(4))]


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


@dataclass
class SpanModel:
    """Per group - kind, loose - the share of true candidates, each labeler's chances of a yes
    on true and on other candidates, and the classifier's weights. ``share``, ``hit``, ``false``: over all groups."""

    share: float = 0.5
    hit: list[float] = field(default_factory=lambda: list(_STRICT[0]))
    false: list[float] = field(default_factory=lambda: list(_STRICT[1]))
    shares: dict[tuple[int, bool], float] = field(default_factory=lambda: dict(SHARE))
    hits: dict[tuple[int, bool], list[float]] = field(default_factory=lambda: {g: list(p[0]) for g, p in PRIOR.items()})
    falses: dict[tuple[int, bool], list[float]] = field(default_factory=lambda: {g: list(p[1]) for g, p in PRIOR.items()})
    weights: dict[tuple[int, bool], list[float]] = field(default_factory=dict)

    @staticmethod
    def group(kind: int, vote: int) -> tuple[int, bool]:
        return kind, bool(vote & LOOSE_BIT)

    def naive(self, g: tuple[int, bool]) -> list[float]:
        """The classifier that the labelers alone make."""
        h, f = self.hits[g], self.falses[g]
        yes, no = [math.log(a / b) for a, b in zip(h, f, strict=True)], [math.log((1 - a) / (1 - b)) for a, b in zip(h, f, strict=True)]
        return [math.log(self.shares[g] / (1 - self.shares[g])), *yes, *no, *[0.0] * 8]

    @classmethod
    def fit(cls, counts: dict[tuple[int, int], int], rounds: int = 50, steps: int = 200) -> SpanModel:
        """``counts``: (kind, vote) -> candidates. Pseudo-counts keep every estimate inside (0, 1)."""
        m = cls()
        groups = sorted({cls.group(*key) for key in counts})
        post = dict.fromkeys(counts, 0.5)
        for _ in range(rounds):
            logit = {g: m.naive(g) for g in groups}
            for key in counts:
                w = logit[cls.group(*key)]
                post[key] = _sigmoid(sum(a * b for a, b in zip(w, _features(key[1]), strict=True)))
            for g in groups:
                own = {k: n for k, n in counts.items() if cls.group(*k) == g}
                yes, total = sum(n * post[k] for k, n in own.items()), sum(own.values())
                m.shares[g] = (yes + 4 * SHARE[g]) / (total + 4)
                for i in range(len(LABELERS)):
                    cast = [(n * post[k], n * (1 - post[k]), _votes(k[1])[i]) for k, n in own.items()]
                    for into, at, prior in ((m.hits, 0, PRIOR[g][0][i]), (m.falses, 1, PRIOR[g][1][i])):
                        on, all_ = sum(c[at] for c in cast if c[2] > 0), sum(c[at] for c in cast if c[2])
                        x = (on + STRENGTH * prior) / (all_ + STRENGTH)
                        into[g][i] = min(max(x, prior - TRUST, 0.01), prior + TRUST, 0.99) if g[1] else x
        for g in groups:
            m.weights[g] = cls._logistic(m.naive(g), [(_features(k[1]), n, post[k]) for k, n in counts.items() if cls.group(*k) == g], steps)
        total = sum(counts.values())
        m.share = (sum(n * post[k] for k, n in counts.items()) + 1) / (total + 2)
        for i in range(len(LABELERS)):
            for into, sign, prior in ((m.hit, 0, _STRICT[0][i]), (m.false, 1, _STRICT[1][i])):
                cast = [(n * abs(sign - post[k]), _votes(k[1])[i]) for k, n in counts.items()]
                into[i] = (sum(c for c, v in cast if v > 0) + 2 * prior) / (sum(c for c, v in cast if v) + 2)
        return m

    @staticmethod
    def _logistic(start: list[float], rows: list[tuple[list[float], int, float]], steps: int) -> list[float]:
        """Gradient steps on the cross-entropy to the posteriors with a ridge around ``start``."""
        w = list(start)
        scale = 2 / (sum(n for _, n, _ in rows) * 8 + 4 * RIDGE)  # below the inverse of the curvature
        for _ in range(steps):
            grad = [RIDGE * (a - b) for a, b in zip(w, start, strict=True)]
            for x, n, y in rows:
                d = n * (_sigmoid(sum(a * b for a, b in zip(w, x, strict=True))) - y)
                for j, f in enumerate(x):
                    grad[j] += d * f
            w = [a - scale * g for a, g in zip(w, grad, strict=True)]
        return w

    def of(self, g: tuple[int, bool]) -> list[float]:
        return self.weights.get(g) or self.naive(g)

    def probability(self, kind: int, vote: int) -> float:
        return _sigmoid(sum(a * b for a, b in zip(self.of(self.group(kind, vote)), _features(vote), strict=True)))

    def accepts(self, x: Column) -> Column:
        """Whether a loose candidate's probability is one half or more, as an expression."""
        weights = [self.of((k, True)) for k in range(len(KINDS))]
        of = lambda j: F.get(F.array(*[F.lit(w[j]) for w in weights]), x["k"])
        bit = lambda n: x["vote"].bitwiseAND(1 << n) != 0
        score = of(0)
        for i in range(len(LABELERS)):
            yes, silent = (bit(9), ~bit(9) & ~bit(8)) if i == 4 else (bit(i), bit(4 + i))
            score += F.when(silent, 0.0).when(yes, of(1 + i)).otherwise(of(6 + i))
        step = lambda n: F.shiftright(x["vote"], n).bitwiseAND(3)
        for at, n in ((11, 10), (15, 12)):
            score += F.get(F.array(*[of(at + k) for k in range(4)]), step(n))
        return score >= 0


def fit(found: DataFrame, column: str = "c") -> SpanModel:
    """``found``: a column of candidates."""
    rows = found.select(F.explode(column).alias("c"))
    counts = rows.groupBy(F.col("c.k").alias("k"), F.col("c.vote").alias("v")).count().collect()  # at most 4 x 2^14 rows
    return SpanModel.fit({(r["k"], r["v"]): r["count"] for r in counts})


def _spans(c: Column, model: SpanModel) -> Column:
    """Base and accepted candidates, in order of kind and start."""
    return F.sort_array(F.filter(c, lambda x: F.when(x["strict"], x["valid"]).otherwise(model.accepts(x))))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (long; the base), base_sha256, spans, n_added."""
    found = materialize(docs.select(F.col(doc_id).alias("doc_id"), candidates(text_of(text)).alias("c")), "candidates")
    model = fit(found)
    base = F.sort_array(F.filter("c", lambda x: x["strict"] & x["valid"]))
    out = found.select("doc_id", base.alias("b"), _spans(F.col("c"), model).alias("s"))
    count = lambda i: F.size(F.filter("b", lambda x: x["k"] == i)).cast("long")
    return out.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_joined(F.col("b")), 256).alias("base_sha256"),
        _joined(F.col("s")).alias("spans"), (F.size("s") - F.size("b")).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in angle brackets. A null text stays null.
    Candidates are found once and written with the rows."""
    name = "candidates"
    while name in docs.columns:
        name += "_"
    found = materialize(docs.withColumn(name, candidates(text_of(text))), "candidates")
    model = fit(found, name)

    def apply(t: Column, spans: Column) -> Column:
        # Spans of different kinds may overlap: in order of start, one that begins inside an earlier one is covered by its label.
        order = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))

        def merge(o: Column) -> Column:
            names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

            def parts(prior: Column) -> Column:
                return F.transform(o, lambda x, i: F.concat(
                    F.substring(t, F.get(prior, i) + 1, F.greatest(F.lit(0), x["s"] - F.get(prior, i))),
                    F.when(F.get(prior, i) <= x["s"], F.get(names, x["k"])).otherwise(F.lit("")),
                ))

            tail = F.substring(t, F.array_max(F.transform(o, lambda y: y["e"])) + 1, F.length(t))
            return F.concat(F.array_join(let(running(F.transform(o, lambda y: y["e"]), F.greatest), parts), ""), tail)

        return let(order, merge)

    new = let(F.col(text), lambda t: let(_spans(F.col(name), model), lambda s: F.when(F.size(s) == 0, t).otherwise(apply(t, s))))
    return found.withColumn(text, F.when(F.col(text).isNull(), F.col(text)).otherwise(new)).drop(name)
