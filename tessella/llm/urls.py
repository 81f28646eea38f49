"""URL filter: rules first, then the ratio of two variable-order Markov models over characters. DataFrame functions only.

Characters are mapped to an alphabet of 32 symbols (A-Z as a-z, one symbol for digits, `.`, `-`, `/`, one for the rest,
one for the edge). Two models, for accepted and for rejected URLs, are counted over all URLs of the table that a rule or
a marker word labels and whose host isn't held out. Contexts of up to two symbols are all kept; one of three to ORDER
symbols only where the evidence pays for it: it was seen LEAST times or more, and the gain in likelihood over its longest
kept suffix outweighs its parameters (half the logarithm of its count for each symbol).
A symbol's probability is that in the longest kept context before it, smoothed by Witten-Bell: a context that was seen
rarely leans on its longest kept suffix. Where CONTEXTS or fewer were seen often enough, the log ratios of the kept ones are
one array, found through a table with two places for a key, so scoring is a projection that looks up one number per
character. More of them stay a table: they are weighed order by order through joins, and each distinct URL meets the ratios
of its codes. Both ways keep the same contexts.

A URL's score is the sum of its log ratios over its length. The threshold is calibrated on held-out hosts (one in FOLDS by
hash): the one with the least sum of both error rates there. URLs above are blocked. Counting is an aggregation over all
rows; the driver sees 2 * 32 ** 3 counts and CONTEXTS + 1 contexts at most, whatever the input's size.

Defined cases: a null URL, or one without `://`, has an empty host and path and no rule; null and empty URLs have
score 0 and are allowed. Every row is judged by itself, so repeated rows, null ids and ties need no rule. If one of the
two models has no examples, all scores are 0 and nothing is blocked but by rules. If the held-out hosts lack a class, all
labelled URLs calibrate. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut

#: (verdict, rule host, rule path), as in the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

# Marker words of hosts that label training examples as rejected.
MARKERS = ("spam", "pills", "casino", "viagra", "porn", "xxx", "warez", "lottery", "payday", "phish")

LETTERS = "abcdefghijklmnopqrstuvwxyz"
N = 32
DIGIT, DOT, DASH, SLASH, REST, EDGE = range(26, 32)
CLAMP, BINS = 8.0, 400
#: Longest context; least count of contexts of three symbols and more, and how many of them go to literals; one host in FOLDS calibrates.
ORDER, LEAST, CONTEXTS, FOLDS = 5, 30, 4096, 5
#: Odd multipliers of the two places of a key.
PLACES = (2654435761, 2246822519)


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), LETTERS.upper(), LETTERS)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is asked first
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def symbols(url: Column) -> Column:
    """The URL as symbols with ORDER edges before and one behind."""
    shown = F.translate(F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), LETTERS.upper(), LETTERS), "[^a-z0-9./-]", "?"), "0123456789", "0000000000")
    code = F.ascii
    raw = F.transform(F.filter(F.split(shown, ""), lambda c: c != ""), lambda c: F.when(c == "0", DIGIT).when(c == ".", DOT).when(c == "-", DASH).when(c == "/", SLASH).when(c == "?", REST).otherwise(code(c) - 97))
    return F.concat(F.array(*[F.lit(EDGE)] * ORDER), raw, F.array(F.lit(EDGE)))


def grams(s: Column) -> Column:
    """Codes of ORDER + 1 symbols in a row, one for each symbol of the URL."""

    def code(i: Column) -> Column:
        out = F.element_at(s, i)
        for k in range(1, ORDER + 1):
            out = out * N + F.element_at(s, i + k)
        return out

    return F.transform(F.sequence(F.lit(1), F.size(s) - ORDER), code)


def log_probabilities(counts: dict[int, int]) -> list[float]:
    """log P(third | first two) of every code, from counts of codes: longest context with counts, Witten-Bell smoothing."""
    c2, c1, c0 = [0] * N**2, [0] * N, 0
    d2, d1 = [0] * N**2, [set() for _ in range(N)]
    pair, single = [0] * N**2, [0] * N
    for code, n in counts.items():
        a, b, c = code // N**2, code // N % N, code % N
        c2[a * N + b] += n
        d2[a * N + b] += 1
        c1[b] += n
        d1[b].add(c)
        pair[b * N + c] += n
        single[c] += n
        c0 += n
    kinds = sum(1 for n in single if n)
    p0 = [(single[c] + kinds / N) / (c0 + kinds) if c0 else 1 / N for c in range(N)]
    p1 = [(pair[b * N + c] + len(d1[b]) * p0[c]) / (c1[b] + len(d1[b])) if c1[b] else p0[c] for b in range(N) for c in range(N)]
    return [math.log((counts.get(code, 0) + d2[code // N] * p1[code % N**2]) / (c2[code // N] + d2[code // N]) if c2[code // N] else p1[code % N**2]) for code in range(N**3)]


def labelled(host: Column, path: Column, rules=RULES, markers=MARKERS) -> Column:
    """1 for examples of rejected URLs, 0 for accepted ones, else null.

    A marker in the host rejects. A URL that a blocking rule takes says nothing about its looks and is no example; all
    others with a host are accepted ones.
    """
    marked = F.lit(False)
    for m in markers:
        marked = marked | host.contains(m)
    return F.when(marked, 1).when(ruled(host, path, rules)[1] == "block", F.lit(None).cast("int")).when(host != "", 0)


def context_key(order: int, context: int) -> int:
    """A number for a context: a one, then its symbols."""
    return N**order + context


def pruned(base: tuple[list[float], list[float]], contexts: dict[int, tuple[dict[int, int], dict[int, int]]]) -> dict[int, tuple[list[float], list[float]]]:
    """log P(symbol | context) of both models for the contexts that their counts pay for.

    base: log probabilities by code of three symbols; contexts: by key, counts by symbol of accepted and rejected URLs.
    """
    kept: dict[int, tuple[list[float], list[float]]] = {}

    def lower(key: int, label: int) -> list[float]:
        order = (key.bit_length() - 1) // 5
        while order > 3:
            order -= 1
            key = context_key(order, key % N**order)
            if key in kept:
                return kept[key][label]
        at = key % N**2 * N
        return base[label][at : at + N]

    for key in sorted(contexts):  # shorter contexts first
        made, gain, cost = [], 0.0, 0.0
        for label, counts in enumerate(contexts[key]):
            n, kinds, under = sum(counts.values()), len(counts), lower(key, label)
            made.append([math.log((counts.get(c, 0) + kinds * math.exp(under[c])) / (n + kinds)) if n else under[c] for c in range(N)])
            gain += sum(k * (made[label][c] - under[c]) for c, k in counts.items())
            cost += 0.5 * kinds * math.log(n) if n else 0.0
        if gain > cost:
            kept[key] = (made[0], made[1])
    return kept


def place(key: int, which: int, bits: int) -> int:
    return (key * PLACES[which] >> 11) % (1 << bits)


def two_places(keys: list[int]) -> tuple[int, list[int]]:
    """(bits, slots): each key at one of its two places, -1 where none is."""
    bits = max(4, (4 * len(keys)).bit_length())
    while True:
        slots, placed = [-1] * (1 << bits), True
        for key in keys:
            which = 0
            for _ in range(200):
                at = place(key, which, bits)
                key, slots[at] = slots[at], key  # who was there moves to its other place
                if key < 0:
                    break
                which = 1 if place(key, 0, bits) == at else 0
            else:
                placed = False
                break
        if placed:
            return bits, slots
        bits += 1


def _literal(xs, kind: str) -> Column:
    """An array that is folded to one literal."""
    return F.split(F.lit(",".join(map(repr, xs))), ",").cast(f"array<{kind}>")


class Ratios:
    """The log ratios: of all codes of three symbols, and of kept longer contexts."""

    def __init__(self, base: list[float], kept: dict[int, list[float]]):
        self.bits, self.slots = two_places(sorted(kept))
        self.rows = {key: i for i, key in enumerate(sorted(kept))}
        self.flat = base + [x for key in sorted(kept) for x in kept[key]]
        self.orders = sorted({(k.bit_length() - 1) // 5 for k in kept}, reverse=True)

    def score(self, s: Column) -> Column:
        """The mean log ratio of a URL's symbols; 0 for an empty URL."""
        flat, keys, starts = _literal(self.flat, "double"), _literal(self.slots, "int"), _literal([N**3 + N * self.rows[k] if k >= 0 else 0 for k in self.slots], "int")

        def row(code: Column) -> Column:
            """Where the log ratios of the longest kept context begin."""
            out = F.pmod(F.shiftright(code, 5), F.lit(N**2)) * N
            for order in reversed(self.orders):
                key = (F.pmod(F.shiftright(code, 5), F.lit(N**order)) + N**order).cast("long")
                for which in (0, 1):
                    at = F.pmod(F.shiftright(key * PLACES[which], 11), F.lit(1 << self.bits)).cast("int")
                    out = F.when(F.get(keys, at) == key, F.get(starts, at)).otherwise(out)
            return out

        codes = grams(s)
        total = F.aggregate(codes, F.lit(0.0), lambda acc, code: acc + F.get(flat, (row(code) + F.pmod(code, F.lit(N))).cast("int")))
        return F.when(F.size(s) > ORDER + 1, total / F.size(codes)).otherwise(F.lit(0.0))

    def on(self, rows: DataFrame) -> DataFrame:
        """rows(s, ...) with their score."""
        return rows.withColumn("score", self.score(F.col("s")))


class RatioTable:
    """The log ratios where too many contexts were seen often for literals: kept contexts as a table for each order."""

    def __init__(self, base: tuple[list[float], list[float]], contexts: DataFrame):
        """contexts(key, counts): counts of (label, symbol, n)."""
        self.base, self.kept = base, {}
        for order in range(3, ORDER + 1):  # shorter contexts first
            own = self._under(contexts.where((F.col("key") >= N**order) & (F.col("key") < 2 * N**order)), F.col("key"), order - 1)
            for label in (0, 1):
                own = self._made(own, label)
            gain, cost = F.col("g0") + F.col("g1"), F.col("k0") + F.col("k1")
            self.kept[order] = cut(own.where(gain > cost).select("key", "m0", "m1"))

    @staticmethod
    def _made(own: DataFrame, label: int) -> DataFrame:
        """own with one model's log probabilities m, their gain in likelihood over those of u, and their cost."""
        under, made, symbol = F.col(f"u{label}"), F.col(f"m{label}"), lambda x: x["symbol"].cast("int")
        own = own.withColumn("_c", F.filter("counts", lambda x: x["label"] == label))
        own = own.withColumn("_n", F.aggregate("_c", F.lit(0).cast("long"), lambda a, x: a + x["n"]).cast("double")).withColumn("_k", F.size("_c").cast("double"))
        own = own.withColumn("_m", F.map_from_entries(F.transform("_c", lambda x: F.struct(symbol(x), x["n"].cast("double")))))
        seen = F.transform(under, lambda u, i: F.ln((F.coalesce(F.element_at("_m", i), F.lit(0.0)) + F.col("_k") * F.exp(u)) / F.nullif(F.col("_n") + F.col("_k"), F.lit(0.0))))
        own = own.withColumn(f"m{label}", F.when(F.col("_n") > 0, seen).otherwise(under))
        own = own.withColumn(f"g{label}", F.aggregate("_c", F.lit(0.0), lambda a, x: a + x["n"] * (F.get(made, symbol(x)) - F.get(under, symbol(x)))))
        return own.withColumn(f"k{label}", F.when(F.col("_n") > 0, 0.5 * F.col("_k") * F.ln("_n")).otherwise(F.lit(0.0)))

    def _under(self, rows: DataFrame, context: Column, longest: int) -> DataFrame:
        """rows with u0, u1: the log probabilities of both models in the longest kept suffix, of at most `longest` symbols, of a context."""
        found = [[], []]
        for order in range(longest, 2, -1):
            own = self.kept[order].select(F.col("key").alias(f"_s{order}"), F.col("m0").alias(f"_p{order}"), F.col("m1").alias(f"_q{order}"))
            rows = rows.join(own, F.pmod(context, F.lit(N**order)) + N**order == F.col(f"_s{order}"), "left")
            found[0].append(f"_p{order}")
            found[1].append(f"_q{order}")
        at = (F.pmod(context, F.lit(N**2)) * N + 1).cast("int")
        made = [F.coalesce(*found[k], F.slice(_literal(self.base[k], "double"), at, N)).alias(f"u{k}") for k in (0, 1)]
        return rows.select("*", *made).drop(*(c for names in found for c in names), *(f"_s{order}" for order in range(3, longest + 1)))

    def on(self, rows: DataFrame) -> DataFrame:
        """rows(s, ...) with their score, in billionths so that sums don't depend on their order."""
        rows = cut(rows)
        codes = rows.select("s").distinct().where(F.size("s") > ORDER + 1).select("s", F.explode(grams(F.col("s"))).alias("code"))
        each = self._under(codes.select("code").distinct(), F.shiftright("code", 5), ORDER)
        symbol = F.pmod("code", F.lit(N)).cast("int")
        each = each.select("code", F.round((F.get("u1", symbol) - F.get("u0", symbol)) * 1e9).cast("long").alias("r"))
        scores = codes.join(each, "code").groupBy("s").agg((F.sum("r") / F.lit(1e9) / F.count("*")).alias("score"))
        return rows.join(scores, "s", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def ratios(urls: DataFrame) -> Ratios | RatioTable:
    """The models, from urls(s, label): s as `symbols` gives them."""
    codes = urls.where("label is not null").select("label", F.explode(grams(F.col("s"))).alias("code")).groupBy("label", "code").agg(F.count("*").alias("n"))
    rows = codes.groupBy("label", (F.col("code") % N**3).alias("code")).agg(F.sum("n").alias("n")).collect()  # 2 * 32 ** 3 rows at most
    by = {k: {r["code"]: r["n"] for r in rows if r["label"] == k} for k in (0, 1)}
    if not by[0] or not by[1]:
        return Ratios([0.0] * N**3, {})
    base = log_probabilities(by[0]), log_probabilities(by[1])
    keys = F.array(*(F.pmod(F.shiftright("code", 5), F.lit(N**k)) + N**k for k in range(3, ORDER + 1)))
    each = codes.select("label", "n", F.pmod("code", F.lit(N)).alias("symbol"), F.explode(keys).alias("key")).groupBy("key", "label", "symbol").agg(F.sum("n").alias("n"))
    common = each.groupBy("key").agg(F.sum("n").alias("total"), F.collect_list(F.struct("label", "symbol", "n")).alias("counts"))  # 2 * 32 counts at most
    often = common.where(F.col("total") >= LEAST)
    found = often.limit(CONTEXTS + 1).collect()
    if len(found) > CONTEXTS:
        return RatioTable(base, cut(often.select("key", "counts")))
    kept = pruned(base, {r["key"]: tuple({c["symbol"]: c["n"] for c in r["counts"] if c["label"] == k} for k in (0, 1)) for r in found})
    return Ratios([round(b - a, 9) for a, b in zip(*base, strict=True)], {k: [round(b - a, 9) for a, b in zip(*v, strict=True)] for k, v in kept.items()})


def calibrated(scored: DataFrame) -> float | None:
    """The threshold with the least sum of error rates on scored(score, label); None without rows of both classes."""
    width = 2 * CLAMP / BINS
    bins = F.least(F.greatest(F.floor((F.col("score") + CLAMP) / width), F.lit(0)), F.lit(BINS - 1)).cast("int")
    rows = scored.where("label is not null").groupBy(bins.alias("bin"), "label").count().collect()  # 2 * BINS rows at most
    n = {(r["bin"], r["label"]): r["count"] for r in rows}
    totals = [sum(v for (_, y), v in n.items() if y == k) for k in (0, 1)]
    if not all(totals):
        return None
    missed, wrong, best = 0.0, 1.0, []
    for b in range(BINS):
        best.append((round(missed + wrong, 12), b))
        missed += n.get((b, 1), 0) / totals[1]
        wrong -= n.get((b, 0), 0) / totals[0]
    least = min(best)[0]
    ties = [b for e, b in best if e == least]
    return (ties[0] + ties[-1]) / 2 * width - CLAMP  # the middle of the gap between the classes


def judged(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, markers=MARKERS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of pages."""
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"), symbols(F.col("url")).alias("s"))
    rows = rows.withColumn("label", labelled(F.col("host"), F.col("path"), rules, markers))
    held = F.pmod(F.xxhash64("host"), F.lit(FOLDS)) == 0
    scored = ratios(rows.where(~held)).on(rows).select("page_id", "host", "path", "label", held.alias("held"), "score")
    threshold = calibrated(scored.where("held"))
    threshold = calibrated(scored) if threshold is None else threshold
    threshold = CLAMP if threshold is None else threshold
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.round("score", 6).alias("score"))
