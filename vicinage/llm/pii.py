"""Personal data by weak supervision, in DataFrame functions only.

Base spans come from four fixed patterns. Looser patterns give further candidates. Every candidate, base ones
included, gets three votes: a regex labeler (how strict a form it has), a gazetteer labeler (known top-level
domains, card prefixes, reserved address blocks, area codes) and a context labeler (cue words just before it).
Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability; its posteriors are
the targets of a logistic span classifier over votes and form, fitted on the same counts. Both see a table of at
most a few thousand cells however large the input is. The classifier decides which further candidates are added.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
#: Looser forms, and the matches of a base pattern that its check drops (mistyped numbers, or no such numbers at all).
ADDED = ("email_like", "phone_like", "id_like", "card_like", "ip_like", "iban_like", "number_like")
KINDS = BASE + ADDED
DROPPED = {"card_like": "card", "ip_like": "ip"}
#: Possessive forms of the contract's patterns: equal matches, no backtracking over long runs.
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "email_like": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
    "phone_like": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "id_like": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban_like": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "number_like": r"(?<![0-9A-Za-z.+-])[0-9]{8,12}(?![0-9A-Za-z]|[.-][0-9])",
}
#: A cheap test that must hold for the pattern to match at all.
GATE = {"email": r"@", "phone": r"\+[0-9]", "ip": r"[0-9]\.[0-9]", "email_like": r"[\[(]\x20?(?:at|AT)\x20?[\])]", "phone_like": r"[0-9]{3}[\x20.-][0-9]{4}", "id_like": r"[0-9]-[0-9]{2}-[0-9]", "iban_like": r"[A-Z]{2}[0-9]{2}", "number_like": r"[0-9]{8}"}
#: Gazetteers and cue words: fixed values.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "co", "de", "fr", "es", "it", "uk", "eu", "us")
COUNTRIES = ("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "GR", "HU", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
ANY_CUES = ("mail", "e-mail", "contact", "phone", "tel", "call", "mobile", "fax", "ssn", "social", "card", "visa", "credit", "account", "address", "host", "server", "reach", "write", "from", "by", "at")
NUMBER_CUES = ("phone", "tel", "telephone", "call", "mobile", "fax", "cell", "ssn", "passport", "account", "customer", "patient")
CUES = {"card_like": ("card", "visa", "mastercard", "amex", "credit", "debit"), "ip_like": ("ip", "host", "server", "address"), "iban_like": ("iban", "account", "bank", "transfer"), "number_like": NUMBER_CUES}
COUNTER_CUES = ("version", "release", "section", "chapter", "isbn", "issn", "order", "item", "part", "page", "figure", "ratio", "score")
#: How sure a kind is before any vote is seen, as (true, false) pseudo-counts; what a check has dropped is likely false.
PRIOR = {"card_like": (1, 9), "ip_like": (1, 9), "number_like": (1, 9)}
#: Characters before a match that the context labeler reads: as far as its cue words may stand.
CONTEXT = 32
STEP = 512


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", F.when(F.length(digits) <= 19, digits).otherwise(F.lit("1")))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _regex_vote(kind: str, m: Column) -> Column:
    strict = {
        "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,4}\.[A-Za-z]{2,12}$",
        "ip": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
        "card": r"^[0-9]{16}$|^[0-9]{4}(?:[ -][0-9]{4}){3}$",
        "phone": r"^\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,3}$",
        "email_like": r"(?i)^[a-z0-9][a-z0-9._-]* ?[\[(] ?at ?[\])] ?[a-z0-9-]+(?: ?[\[(] ?dot ?[\])] ?|\.)[a-z]{2,6}$",
        "phone_like": r"^(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}$",
        "card_like": r"^[0-9]{16}$|^[0-9]{4}(?:[ -][0-9]{4}){3}$",
        "ip_like": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
        "iban_like": r"^[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?$|^[A-Z]{2}[0-9]{13,28}$",
        "number_like": r"^0?[1-9][0-9]{8,10}$",
        "id_like": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    }[kind]
    return F.when(m.rlike(strict), F.lit(1)).otherwise(F.lit(-1))


def _gazetteer_vote(kind: str, m: Column) -> Column:
    if kind in ("email", "email_like"):
        return F.when(F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS), F.lit(1)).otherwise(F.lit(-1))
    if kind == "ip":
        return F.when(m.rlike(r"^(?:0|10|127|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."), F.lit(-1)).otherwise(F.lit(1))
    if kind == "card":
        return F.when(m.rlike(r"^(?:4|5[1-5]|2[2-7]|6011|65|35)"), F.lit(1)).otherwise(F.lit(0))
    if kind == "phone":
        return F.when(m.rlike(r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), F.lit(1)).otherwise(F.lit(-1))
    if kind == "card_like":  # the checksum speaks against it; a known prefix takes that back
        return F.when(m.rlike(r"^(?:4|5[1-5]|2[2-7]|6011|65|35)"), F.lit(0)).otherwise(F.lit(-1))
    if kind == "ip_like":
        return F.lit(-1)
    if kind == "iban_like":
        return F.when(F.substring(m, 1, 2).isin(*COUNTRIES), F.lit(1)).otherwise(F.lit(-1))
    if kind == "phone_like":
        return F.when(m.rlike(r"^\(?[2-9][0-8][0-9]"), F.lit(1)).otherwise(F.lit(-1))
    return F.lit(0)


def _context_vote(kind: str, before: Column) -> Column:
    near = F.lower(before)
    cues = "|".join(CUES.get(kind, ANY_CUES))
    return F.when(near.rlike(r"(?:^|[^a-z])(?:" + "|".join(COUNTER_CUES) + r")[^a-z]{0,6}$"), F.lit(-1)).when(near.rlike(rf"(?:^|[^a-z])(?:{cues})(?:[^a-z]|[^a-z][a-z]{{1,8}}[^a-z]{{1,3}})$"), F.lit(1)).otherwise(F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], empty: str) -> Column:
    """An array (of the type of ``empty``) with an element for each item, from left to right with a state.

    The results are gathered STEP at a time, so the work follows the number of items (but for a copy of references
    every STEP of them). ``items`` has to be a column or a lambda's variable.
    """
    start = lambda state: F.struct(state.alias("state"), F.expr(empty).alias("out"))

    def one(acc: Column, x: Column) -> Column:
        state, element = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(element)).alias("out"))

    def some(acc: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(items, k * STEP + 1, F.lit(STEP)), start(acc["state"]), one)
        return let(part, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], x["out"]).alias("out")))

    steps = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / STEP).cast("int"))
    return F.when(F.size(items) > 0, F.aggregate(steps, start(zero), some, lambda acc: acc["out"])).otherwise(F.expr(empty))


NO_SPANS = "cast(array() as array<struct<s:int,e:int,m:string,before:string>>)"


def _positions(kind: str) -> Column:
    """array<struct<s, e, m, before>> of all matches of a pattern in _text, from the stretches between them."""
    pattern = PATTERN[kind]
    found = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
    if kind in GATE:
        found = F.when(F.col("_text").rlike(GATE[kind]), found).otherwise(F.array().cast("array<string>"))

    def place(matches: Column) -> Column:
        gaps = F.slice(F.split("_text", pattern, -1), 1, F.size(matches))
        pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m"), F.substring(g, -CONTEXT, CONTEXT).alias("b")))
        one = lambda at, p: (at + p["g"] + p["n"], F.struct((at + p["g"]).alias("s"), (at + p["g"] + p["n"]).alias("e"), p["m"].alias("m"), p["b"].alias("before")))
        return F.when(F.size(matches) > 0, let(pairs, lambda p: fold(p, F.lit(0), one, NO_SPANS))).otherwise(F.expr(NO_SPANS))

    return let(found, place)


def _free(base: Column, more: Column) -> Column:
    """``more`` (array<struct<kind, s, e, m, before>>) without what touches a span of ``base``, by kind and start.

    Both are merged by start and gone through forwards with the furthest end of a base span, and backwards with the
    nearest start of one.
    """
    kind = "array<struct<s:int,e:int,kind:int,m:string,before:string,free:boolean>>"
    row = lambda x, k: F.struct(x["s"].alias("s"), x["e"].alias("e"), k.alias("kind"), x["m"].alias("m"), x["before"].alias("before"), F.lit(True).alias("free"))
    marked = lambda x, ok: F.struct(*(x[c].alias(c) for c in ("s", "e", "kind", "m", "before")), (x["free"] & ok).alias("free"))
    is_base = lambda x: x["kind"] < 0
    forwards = lambda far, x: (F.when(is_base(x), F.greatest(far, x["e"])).otherwise(far), marked(x, x["s"] >= far))
    backwards = lambda near, x: (F.when(is_base(x), F.least(near, x["s"])).otherwise(near), marked(x, x["e"] <= near))
    merged = F.array_sort(F.concat(F.transform(base, lambda x: row(x, F.lit(-1))), F.transform(more, lambda x: row(x, x["kind"]))))
    empty = f"cast(array() as {kind})"
    first = let(merged, lambda a: fold(a, F.lit(0), forwards, empty))
    both = let(F.reverse(first), lambda a: fold(a, F.lit(2**31 - 1), backwards, empty))
    left = F.filter(both, lambda x: ~is_base(x) & x["free"])
    return F.array_sort(F.transform(left, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["before"].alias("before"))))


def extract(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with _text, _base and _more: arrays of struct<kind, s, e, m, before> of the valid base matches and of
    the further candidates that touch none of them, by kind and then start (kind: index into KINDS).

    Positions are code points, the end exclusive. The columns begin with an underscore and stand beside whatever
    ``rows`` has; callers put their own columns in a struct, so names can't clash.
    """
    out = rows.withColumn("_text", F.coalesce(text, F.lit("")))
    out = out.withColumns({f"_p_{k}": _positions(k) for k in KINDS if k not in DROPPED})
    named = lambda k, p: F.transform(p, lambda x: F.struct(F.lit(KINDS.index(k)).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["before"].alias("before")))
    base = F.concat(*(named(k, F.filter(f"_p_{k}", _keep(k))) for k in BASE))
    more = F.concat(*(named(k, F.filter(f"_p_{DROPPED[k]}", _drop(DROPPED[k])) if k in DROPPED else F.col(f"_p_{k}")) for k in ADDED))
    out = out.withColumns({"_base": base, "_more": more}).drop(*(f"_p_{k}" for k in KINDS))
    both = (F.size("_base") > 0) & (F.size("_more") > 0)
    return out.withColumn("_more", F.when(both, _free(F.col("_base"), F.col("_more"))).otherwise(F.col("_more")))


def _keep(kind: str):
    return lambda x: _valid(kind, x["m"])


def _drop(kind: str):
    return lambda x: ~_valid(kind, x["m"])


def _candidate(kind: str, x: Column) -> Column:
    """Votes and form of a match."""
    return F.struct(
        x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"),
        _regex_vote(kind, x["m"]).alias("rx"), _gazetteer_vote(kind, x["m"]).alias("gz"), _context_vote(kind, x["before"]).alias("cx"),
        F.least(F.floor((x["e"] - x["s"]) / 4), F.lit(7)).cast("int").alias("size"),
        F.least(F.length(F.regexp_replace(x["m"], "[A-Za-z0-9]", "")), F.lit(5)).alias("seps"),
    )


def candidates(extracted: DataFrame) -> DataFrame:
    """Adds _cands: array<struct<kind, s, e, rx, gz, cx, size, seps>> over all kinds, in the order of KINDS."""
    none = F.expr("cast(array() as array<struct<kind:int,s:int,e:int,rx:int,gz:int,cx:int,size:int,seps:int>>)")

    def of_kind(col: str, kind: str) -> Column:
        return F.transform(F.filter(col, lambda x: x["kind"] == KINDS.index(kind)), lambda x: _candidate(kind, x))

    def voted(col: str, kinds: tuple[str, ...]) -> Column:
        return F.when(F.size(col) > 0, F.concat(*(of_kind(col, k) for k in kinds))).otherwise(none)

    return extracted.withColumn("_cands", F.concat(voted("_base", BASE), voted("_more", ADDED)))


@dataclass(frozen=True)
class Model:
    """Reliabilities by kind and labeler, and weights of the span classifier by feature."""

    prior: dict[int, float]
    reliability: dict[tuple[int, str], dict[int, tuple[float, float]]]
    weights: dict[tuple, float]

    def score(self, c: Column) -> Column:
        """Probability that a candidate struct is personal data, as a column."""
        total = F.lit(self.weights.get(("bias",), 0.0))
        for f in ("rx", "gz", "cx", "size", "seps"):
            values = [w for w in self.weights if w[0] == f]
            part = F.lit(0.0)
            for w in values:
                part = F.when(c[f] == w[1], F.lit(self.weights[w])).otherwise(part)
            total = total + part
        part = F.lit(0.0)
        for w in [w for w in self.weights if w[0] == "kind"]:
            part = F.when(c["kind"] == w[1], F.lit(self.weights[w])).otherwise(part)
        return 1 / (1 + F.exp(-(total + part)))


LABELERS = ("rx", "gz", "cx")


def learn(cands: DataFrame, rounds: int = 40) -> Model:
    """Fit on all candidates of a DataFrame with _cands. What reaches the driver is one row per distinct
    (kind, votes, form): at most 11 * 27 * 8 * 6 cells, whatever the input."""
    cells = [(r["kind"], (r["rx"], r["gz"], r["cx"]), (r["size"], r["seps"]), r["count"]) for r in cands.select(F.explode("_cands").alias("c")).select("c.*").groupBy("kind", "rx", "gz", "cx", "size", "seps").count().collect()]
    cells.sort()
    prior, rel = {}, {}
    posterior: dict[tuple, float] = {}
    for kind in range(len(KINDS)):
        counts: dict[tuple, int] = {}
        for k, votes, _, n in cells:
            if k == kind:
                counts[votes] = counts.get(votes, 0) + n
        # Beta priors: a vote for is likelier on true spans, and one against on false ones
        sure, unsure = PRIOR.get(KINDS[kind], (7, 3))
        p, r = sure / (sure + unsure), {f: {v: (a, b) for v, a, b in ((1, 0.6, 0.15), (0, 0.3, 0.45), (-1, 0.1, 0.4))} for f in LABELERS}
        post: dict[tuple, float] = {}
        for _ in range(rounds):
            for votes in counts:
                a, b = math.log(p), math.log(1 - p)
                for f, v in zip(LABELERS, votes, strict=True):
                    a, b = a + math.log(r[f][v][0]), b + math.log(r[f][v][1])
                post[votes] = 1 / (1 + math.exp(min(50, max(-50, b - a))))
            yes, no = sum(n * post[v] for v, n in counts.items()), sum(n * (1 - post[v]) for v, n in counts.items())
            p = min(0.99, max(0.01, (yes + sure) / (yes + no + sure + unsure)))
            for i, f in enumerate(LABELERS):
                for v, a, b in ((1, 0.6, 0.15), (0, 0.3, 0.45), (-1, 0.1, 0.4)):
                    r[f][v] = ((sum(n * post[x] for x, n in counts.items() if x[i] == v) + 20 * a) / (yes + 20), (sum(n * (1 - post[x]) for x, n in counts.items() if x[i] == v) + 20 * b) / (no + 20))
        prior[kind] = p
        rel |= {(kind, f): r[f] for f in LABELERS}
        posterior |= {(kind, v): q for v, q in post.items()}
    rows = []
    for kind, votes, (size, seps), n in cells:
        rows.append(([("bias",), ("kind", kind), *((f, v) for f, v in zip(LABELERS, votes, strict=True)), ("size", size), ("seps", seps)], posterior[kind, votes], n))
    total = max(1, sum(n for *_, n in rows))
    weights = {f: 0.0 for x, *_ in rows for f in x}
    for _ in range(200):  # weighted logistic regression by gradient steps on the cells, lightly shrunk
        grad = {f: 0.002 * w for f, w in weights.items()}
        for x, y, n in rows:
            q = 1 / (1 + math.exp(-min(30, max(-30, sum(weights[f] for f in x)))))
            for f in x:
                grad[f] += n / total * (q - y)
        weights = {f: w - 1.0 * grad[f] for f, w in weights.items()}
    return Model(prior, rel, weights)


def with_spans(cands: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Adds _spans: array<struct<kind, s, e, p>> of the base spans and the added ones the classifier accepts."""
    scored = F.transform("_cands", lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), model.score(c).alias("p")))
    return cands.withColumn("_spans", F.filter(scored, lambda x: (x["kind"] < len(BASE)) | (x["p"] >= threshold)))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, by kind as listed and then start (the order spans are built in)."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def find(docs: DataFrame, save, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Personal data of every text: id, spans array<struct<kind, s, e, p>> (kind: index into KINDS).

    ``save`` writes a DataFrame to a table and gives it back; only ids, spans and votes are written. A null or
    empty text has no spans; a null id is kept; repeated rows give repeated results; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    found = save(candidates(extract(rows, F.col("_t"))).select("_id", "_cands"))
    return with_spans(found, learn(found), threshold).select(F.col("_id").alias(id_col), F.col("_spans").alias("spans"))


def redact(docs: DataFrame, save, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and n_chars (if there) set to the new length.

    Where spans overlap, the one that starts first counts (of several, the longest), and what another has beyond its
    end is replaced by the other's kind, so the union of all spans is masked; the other columns, a null text and
    the order of columns stay as they are. ``save`` writes a DataFrame to a table and gives it back: the rows with
    their candidates, so that texts are searched once.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    text = F.col(f"_row.`{text_col}`")
    found = save(candidates(extract(rows, text)).select("_row", "_cands"))
    spanned = with_spans(found, learn(found.select("_cands")), threshold).withColumn("_text", F.coalesce(text, F.lit("")))
    ordered = F.array_sort(F.transform("_spans", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("n"), x["kind"].alias("kind"))))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    none = "cast(array() as array<string>)"
    start = lambda at: F.struct(at.alias("at"), F.expr(none).alias("out"))

    def masked(spans: Column) -> Column:
        def some(acc: Column, k: Column) -> Column:
            """The next STEP spans, in the stretch of text that they reach over: places are counted within it."""

            def inside(part: Column) -> Column:
                far = F.greatest(acc["at"], F.array_max(F.transform(part, lambda x: -x["n"])))
                stretch = F.substring("_text", acc["at"] + 1, far - acc["at"])

                def one(a: Column, x: Column, seg: Column) -> Column:
                    plain = F.substring(seg, a["at"] - acc["at"] + 1, F.greatest(x["s"] - a["at"], F.lit(0)))
                    return F.when(-x["n"] <= a["at"], a).otherwise(F.struct((-x["n"]).alias("at"), F.concat(a["out"], F.array(plain, F.element_at(names, x["kind"] + 1))).alias("out")))

                return let(stretch, lambda seg: F.aggregate(part, start(acc["at"]), lambda a, x: one(a, x, seg)))

            done = let(F.slice(spans, k * STEP + 1, F.lit(STEP)), inside)
            return let(done, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out")))

        steps = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / STEP).cast("int"))
        return let(F.aggregate(steps, start(F.lit(0)), some), lambda x: F.concat(F.array_join(x["out"], ""), F.substring("_text", x["at"] + 1, F.length("_text"))))

    out = spanned.withColumn("_new", F.when(F.size("_spans") > 0, let(ordered, masked)).otherwise(text))

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("_new").alias(c)
        if c == "n_chars":
            return F.coalesce(F.length("_new"), F.lit(0)).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"_row.`{c}`").alias(c)

    return out.select(*(column(c) for c in docs.columns))
