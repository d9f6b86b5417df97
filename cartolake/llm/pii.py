"""Personal data by weak supervision, in DataFrame functions only.

Fixed patterns find the base spans: e-mail addresses, IP addresses, card and phone numbers. Wider patterns propose more candidates:
disguised addresses, phone numbers without a country code, card numbers with a wrong check digit, and assigned secrets. Five labelers
vote on every candidate, base spans included: its shape, its check or form, a gazetteer, the words before it, and what it is glued to.
Votes are counted by pattern over the whole table. Expectation-maximisation estimates, from these counts alone, each kind's share of true
candidates and each labeler's reliability; a logistic span classifier is then fitted to the estimated probabilities, with the votes and
the span's form as its inputs, and scores every candidate. Candidates that reach ACCEPT are added to the base spans, which always stay.

What goes to the driver is one row for each pattern of kind, votes and form that occurs, of which there are 5 * 3^5 * 16 = 19,440 at
most, whatever the input's size. Candidates are searched once, written with the rows, and read again with the scores; nothing is shuffled
but the counts.

Patterns are written so that a start within a run of the same characters isn't tried again, and repeat possessively, so that time is in
proportion to a text's length and the stack doesn't grow with it. They match what the plain forms in BASE match. Places are running
sums over the pieces between matches, overlaps are told from running maxima, and surroundings are read from chunks of CHUNK code points, so
that a text with very many spans takes time in proportion to them too.

Defined results: a null or empty text has no spans; a very long text is searched whole; repeated rows repeat their result; an empty table
gives no rows. Offsets count code points, ends exclusive. Other columns pass through; columns named spans or base_spans are refused.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, refuse

#: The base patterns as they are meant, in the order of their kinds.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*BASE, "secret"]
ACCEPT = 0.9
CONTEXT = 24  # code points before a span that its context labeler reads
ROUNDS, STEPS = 30, 300
CHUNK, RUN = 1024, 64  # code points of a chunk of text; numbers that are summed up at once

_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IS_IP = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
#: The wider patterns.
_WIDE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[{] ?(?:at|AT) ?[)\]}] ?[A-Za-z0-9-]++(?: ?(?:[(\[{] ?(?:dot|DOT) ?[)\]}]|\.) ?[A-Za-z0-9-]++)++"
_WIDE_PHONE = r"(?<![0-9A-Za-z+(.-])(?<![0-9] )(?<!\+[0-9]{1,3} )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![ .-]?[0-9])"
_WIDE_SECRET = r"(?<![A-Za-z0-9])(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Pp]asswd|[Aa][Pp][Ii][ _-]?[Kk][Ee][Yy]|[Aa]ccess[ _-]?[Kk]ey)[\"']? ?[=:] ?[\"']?[A-Za-z0-9_/+=-]{12,}+[\"']?"
#: Fixed word lists of the gazetteer and context labelers.
_TOP_LEVEL = r"\.(?:com|org|net|edu|gov|info|biz|io|de|fr|es|it|nl|uk|eu|ch|at|be|us|ca|mx|ar|br|pl|ru|cn|jp|in|au)$"
_CUES = r"(?i)(?:mail|contact|kontakt|contacto|write to|tel|phone|fono|fon|call|mobile|handy|fax|address|host|server|login|from|card|karte|carte|tarjeta|visa|mastercard|pay|account|token|secret|password|key)"
_COUNTER = r"(?i)(?:version|v\.|isbn|issn|figure|fig\.|page|section|§|article|chapter|order no|serial|doi|release)[ :#.]*$"


def _luhn(match: Column) -> Column:
    """Whether a number passes the Luhn check; meant for at most 19 digits."""
    digits = F.split(F.reverse(F.regexp_replace(match, "[^0-9]", "")), "")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    parts = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 1, doubled(d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, d: a + d) % 10 == 0


def _digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", ""))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, join: Callable[[Column, Column], Column], zero: Column) -> Column:
    """join of each number of an array of int with all before it. Runs of RUN are joined by themselves, then with what stands before them."""

    def along(xs: Column) -> Column:
        none = F.struct(zero.alias("last"), F.array().cast("array<int>").alias("out"))
        step = lambda a, x: _once(join(a["last"], x), lambda y: F.struct(y.alias("last"), F.concat(a["out"], F.array(y)).alias("out")))
        return F.aggregate(xs, none, step)["out"]

    def joined(runs: Column) -> Column:
        before = F.concat(F.array(zero), along(F.transform(runs, lambda r: F.element_at(r, -1))))
        return _once(before, lambda b: F.flatten(F.transform(runs, lambda r, i: F.transform(r, lambda x: join(F.get(b, i), x)))))

    def cut(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda k: along(F.slice(v, k * RUN + 1, F.lit(RUN))))

    return _once(values, lambda v: F.when(F.size(v) <= RUN, along(v)).otherwise(_once(cut(v), joined)))


def _sums(values: Column) -> Column:
    return _running(values, lambda a, x: a + x, F.lit(0))


def _highest(values: Column) -> Column:
    return _running(values, lambda a, x: F.greatest(a, x), F.lit(-1))


def _found(text: Column, pattern: str, kind: int, sign: Column) -> Column:
    """All matches with their places: array<struct<start, end, kind, match>>. sign says whether there can be one, and is cheap."""
    searched = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def placed(s: Column) -> Column:
        ends = _sums(F.zip_with(F.slice(s["p"], 1, F.size(s["m"])), s["m"], lambda p, m: F.length(p) + F.length(m)))
        return F.zip_with(ends, s["m"], lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), F.lit(kind).alias("kind"), m.alias("match")))

    empty = F.array().cast("array<struct<start:int,end:int,kind:int,match:string>>")
    return F.when(sign, _once(searched, lambda s: F.when(F.size(s["m"]) > 0, placed(s)).otherwise(empty))).otherwise(empty)


def _candidates(text: Column) -> Column:
    """Base spans and wider candidates, each with base, whether it is a base span."""
    email, ip, card, phone, secret = range(5)
    has = lambda pattern: F.regexp_like(text, F.lit(pattern))
    valid = lambda x: F.transform(x, lambda s: s.withField("base", F.lit(True)))
    loose = lambda x: F.transform(x, lambda s: s.withField("base", F.lit(False)))
    phones = F.filter(_found(text, _PHONE, phone, F.contains(text, F.lit("+"))), lambda s: _digits(s["match"]).between(9, 15))
    ips = F.filter(_found(text, _IP, ip, has(r"[0-9]\.[0-9]")), lambda s: F.regexp_like(s["match"], F.lit(_IS_IP)))
    cards = F.transform(_found(text, _CARD, card, has(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]")), lambda s: s.withField("base", _luhn(s["match"])))
    found = [
        valid(_found(text, _EMAIL, email, F.contains(text, F.lit("@")))), valid(ips), cards, valid(phones),
        loose(_found(text, _WIDE_EMAIL, email, has(r"(?:at|AT) ?[)\]}]"))), loose(_found(text, _WIDE_PHONE, phone, has(r"[0-9]{3}[ .-][0-9]{4}"))), loose(_found(text, _WIDE_SECRET, secret, has(r"[A-Za-z][\"']? ?[=:]"))),
    ]
    return F.concat(*found)


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _piece(chunks: Column, start: Column, end: Column) -> Column:
    """The text from start up to end, of chunks; costs its own length and two chunks."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    return F.when(end > start, F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start - first * CHUNK + 1, end - start)).otherwise("")


def _votes(s: Column, before: Column, after: Column) -> list[Column]:
    """The labelers' votes on a candidate with CONTEXT code points before it and one after it: 1 personal, -1 not, 0 none."""
    m, kind = s["match"], s["kind"]
    edge = F.concat(F.right(before, F.lit(1)), F.lit(" "), after)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    shape = vote(s["base"], F.lit(False))
    check = (
        F.when(kind == 0, vote(F.regexp_like(m, F.lit(r"[A-Za-z]{2,}$")), F.regexp_like(m, F.lit(r"^[.-]|\.\.|[0-9]$"))))
        .when(kind == 1, vote(~F.regexp_like(m, F.lit(r"(?:^|\.)0[0-9]")), F.regexp_like(m, F.lit(r"^0\."))))
        .when(kind == 2, F.when(s["base"], 1).otherwise(-1))
        .when(kind == 3, vote((_digits(m) >= 10) & F.regexp_like(m, F.lit(r"^\+|^\(?[2-9][0-9]{2}\)?[ .-][2-9]")), _digits(m) < 9))
        .otherwise(vote(F.regexp_like(m, F.lit(r"[=:].*[0-9].*[A-Za-z]|[=:].*[A-Za-z].*[0-9]")), ~F.regexp_like(m, F.lit(r"[=:].*[0-9]"))))
    )
    gazetteer = (
        F.when(kind == 0, vote(F.regexp_like(m, F.lit(_TOP_LEVEL)), F.lit(False)))
        .when(kind == 1, vote(F.regexp_like(m, F.lit(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[0-2][0-9])\.")), F.regexp_like(m, F.lit(r"^(?:0|24[0-9]|25[0-5])\."))))
        .when(kind == 2, vote(F.regexp_like(m, F.lit(r"^(?:3[47]|4|5[1-5]|6)")), F.regexp_like(m, F.lit(r"^0"))))
        .when(kind == 3, vote(F.regexp_like(m, F.lit(r"^\+(?:1|7|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-6]|8[1-6]|9[0-58])")), F.lit(False)))
        .otherwise(vote(F.regexp_like(m, F.lit(_CUES)), F.lit(False)))
    )
    context = vote(F.regexp_like(before, F.lit(_CUES)) | (kind == 4), F.regexp_like(before, F.lit(_COUNTER)))
    glue = vote(F.regexp_like(edge, F.lit(r"^[\s(\[<\"':;,|=]? [\s)\]>\"':;,.!?|]?$")), F.regexp_like(edge, F.lit(r"^[A-Za-z0-9_]|[A-Za-z0-9_]$")))
    return [shape, check, gazetteer, context, glue]


#: Labelers in the order of _votes, and what their reliabilities are held to be before any votes are seen: a check digit says more than a word nearby.
START = (0.9, 0.95, 0.7, 0.7, 0.6)
LABELERS = len(START)


def _pattern(s: Column, before: Column, after: Column) -> Column:
    """kind, votes and form of a candidate as one number, kind * 3^5 * 16 + votes in base 3 * 16 + form."""
    number = s["kind"]
    for v in _votes(s, before, after):
        number = number * 3 + v + 1
    length = F.length(s["match"])
    share = 4 * _digits(s["match"]) / F.greatest(length, F.lit(1))
    form = F.when(length < 12, 0).when(length < 18, 1).when(length < 32, 2).otherwise(3) * 4 + F.least(F.lit(3), F.floor(share))
    return (number * 16 + form).cast("int")


def _parts(pattern: int) -> tuple[int, list[int], int]:
    rest, form = divmod(pattern, 16)
    votes = []
    for _ in range(LABELERS):
        rest, v = divmod(rest, 3)
        votes.append(v - 1)
    return rest, votes[::-1], form


def estimate(counts: dict[int, int]) -> tuple[dict[int, float], list[float]]:
    """EM over pattern counts: the probability that a candidate of each pattern is personal data, and the labelers' reliabilities.

    A labeler votes independently of the others given the truth, abstains whatever the truth, and is right with its own reliability.
    Its estimate is the mean of START and of what the beliefs have, so that labelers that mostly say the same can't outvote a good one;
    each kind's share of true candidates starts from five and five.
    """
    rows = [(_parts(p), p, n) for p, n in sorted(counts.items())]
    right, share = [*START], [0.5] * len(KINDS)
    belief: dict[int, float] = {}
    for _ in range(ROUNDS):
        for (kind, votes, _), p, _n in rows:
            odds = math.log(share[kind] / (1 - share[kind])) + sum(v * math.log(r / (1 - r)) for v, r in zip(votes, right))
            belief[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for j in range(LABELERS):
            agreed = sum(n * (belief[p] if v[j] > 0 else 1 - belief[p]) for (_, v, _f), p, n in rows if v[j])
            voted = sum(n for (_, v, _f), _p, n in rows if v[j])
            right[j] = min(0.99, max(0.5, (START[j] + (agreed / voted if voted else START[j])) / 2))
        for k in range(len(KINDS)):
            own = [(belief[p], n) for (kind, _v, _f), p, n in rows if kind == k]
            share[k] = (5 + sum(b * n for b, n in own)) / (10 + sum(n for _, n in own))
    return belief, right


def _features(pattern: int) -> list[float]:
    kind, votes, form = _parts(pattern)
    hot = lambda i, n: [float(i == k) for k in range(n)]
    return [1.0, *hot(kind, len(KINDS)), *[x for v in votes for x in hot(v + 1, 3)], *hot(form // 4, 4), *hot(form % 4, 4)]


def classifier(counts: dict[int, int]) -> dict[int, float]:
    """Each occurring pattern's score by the span classifier: logistic regression on the beliefs, a pattern weighted by the root of its count."""
    belief, _ = estimate(counts)
    rows = [(_features(p), belief[p], math.sqrt(n)) for p, n in sorted(counts.items())]
    total = sum(w for *_, w in rows) or 1.0
    weights = [0.0] * len(_features(0))
    score = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x))))))
    for _ in range(STEPS):
        slope = [1e-4 * w for w in weights]
        for x, y, w in rows:
            e = (score(x) - y) * w / total
            for j, v in enumerate(x):
                if v:
                    slope[j] += e * v
        weights = [w - 2.0 * g for w, g in zip(weights, slope)]
    return {p: score(_features(p)) for p in counts}


def tagged(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _candidates: array<struct<start, end, kind, base, pattern>>."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def seen(s: Column, chunks: Column) -> Column:
        around = F.struct(_piece(chunks, F.greatest(F.lit(0), s["start"] - CONTEXT), s["start"]).alias("before"), F.substring(_piece(chunks, s["end"], s["end"] + 1), 1, 1).alias("after"))
        return _once(around, lambda a: F.struct(s["start"], s["end"], s["kind"], s["base"], _pattern(s, a["before"], a["after"]).alias("pattern")))

    empty = F.array().cast("array<struct<start:int,end:int,kind:int,base:boolean,pattern:int>>")
    known = lambda spans: F.when(F.size(spans) > 0, _once(_chunks(text), lambda c: F.transform(spans, lambda s: seen(s, c)))).otherwise(empty)
    return docs.withColumn("_candidates", _once(_candidates(text), known))


def fit(found: DataFrame) -> dict[int, float]:
    """The classifier's scores by pattern, from all candidates of tagged()."""
    one = found.select(F.explode("_candidates.pattern").alias("pattern"))
    return classifier({r["pattern"]: r["n"] for r in one.groupBy("pattern").agg(F.count("*").alias("n")).collect()})


def _clear(spans: Column) -> Column:
    """Of spans sorted by start and base spans first, those that are base or overlap no base span: one that begins before it and ends after its
    start, or begins after it and before its end."""

    def told(far: Column) -> Column:
        def free(s: Column, i: Column) -> Column:
            return s["base"] | ((F.get(far["ends"], i) <= s["start"]) & (-F.get(far["starts"], F.size(spans) - 1 - i) >= s["end"]))

        return F.filter(spans, free)

    starts = F.transform(F.reverse(spans), lambda s: F.when(s["base"], -s["start"]).otherwise(F.lit(-(1 << 31) + 1)))
    ends = F.transform(spans, lambda s: F.when(s["base"], s["end"]).otherwise(F.lit(-1)))
    least = _running(starts, lambda a, x: F.greatest(a, x), F.lit(-(1 << 31) + 1))
    return _once(F.struct(_highest(ends).alias("ends"), least.alias("starts")), told)


def detect(docs: DataFrame, text_col: str = "text", scores: dict[int, float] | None = None, keep_text: bool = True) -> DataFrame:
    """docs with base_spans and spans: array<struct<start, kind, end>>, sorted by start, then kind in the order of KINDS.

    Added spans don't overlap base spans. Without scores the candidates are written, with the other columns of docs, to fit them first. The
    text is dropped if keep_text is false.
    """
    refuse(docs, {"spans", "base_spans", "_candidates"})
    found = tagged(docs, text_col)
    found = found if keep_text else found.drop(text_col)
    if scores is None:
        found = materialize(found, "pii-candidates")
        scores = fit(found)
    good = sorted(p for p, s in scores.items() if s >= ACCEPT)
    plain = lambda x: F.transform(x, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    accepted = F.array(*map(F.lit, good)) if good else F.array().cast("array<int>")
    wanted = F.filter("_candidates", lambda s: s["base"] | F.array_contains(accepted, s["pattern"]))
    ordered = F.transform(F.array_sort(F.transform(wanted, lambda s: F.struct(s["start"], (~s["base"]).alias("added"), s["kind"], s["end"]))), lambda s: F.struct(s["start"], s["kind"], s["end"], (~s["added"]).alias("base")))
    mixed = F.exists("_candidates", lambda s: ~s["base"] & F.array_contains(accepted, s["pattern"]))
    spans = _once(ordered, lambda x: F.struct(F.array_sort(plain(F.filter(x, lambda s: s["base"]))).alias("base"), F.array_sort(plain(F.when(mixed, _clear(x)).otherwise(x))).alias("all")))
    return found.withColumn("_candidates", spans).withColumn("base_spans", F.col("_candidates.base")).withColumn("spans", F.col("_candidates.all")).drop("_candidates")


def listed(spans: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; of overlapping spans the first stands for all. A null text stays null."""
    found = detect(docs, text_col)
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def replaced(x: Column) -> Column:
        """x: chunks of the text, its length, and reach, how far the spans up to each one come."""

        def piece(s: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(x["reach"], i - 1)).otherwise(0)
            return F.when(s["start"] >= before, F.concat(_piece(x["chunks"], before, s["start"]), F.get(names, s["kind"]))).otherwise("")

        rest = _piece(x["chunks"], F.element_at(x["reach"], -1), x["length"])
        return F.concat(F.array_join(F.transform("spans", piece), ""), rest)

    text = F.col(text_col)
    parts = F.struct(_chunks(text).alias("chunks"), F.length(text).alias("length"), _highest(F.transform("spans", lambda s: s["end"])).alias("reach"))
    return found.withColumn(text_col, F.when(F.size("spans") > 0, _once(parts, replaced)).otherwise(text)).drop("spans", "base_spans")
