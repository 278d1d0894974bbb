"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base spans (email, ip, card, phone) are found by fixed patterns and checks and always stay. High-recall
generators then propose further spans, overlapping ones too; boosted trees score each from its format and
context, and the best-scored spans that reach a calibrated threshold and overlap nothing chosen before join as
kinds `number`, `secret` and `handle`.

The trees learn from all candidates of all distinct texts (a text of many rows counts once), a third of the texts held out,
from features of format and context that say nothing of the labels' sources. A candidate counts as personal if a checked
base span covers it, if it stands behind a naming word (`NAMED`, which no feature tells), or if its format (generator,
length, kinds of characters) is one of which a share of AGREEING are named and none passed a check. Candidates that are alike are
counted; each level of a tree is one grouping of these counts by feature and value, and the driver gets the splits only. Gradients are summed as
whole numbers of 1 / UNIT, so the trees do not depend on how the rows lie. The trees are written out as one Spark
expression, so scoring runs inside the query. Each kind has its own threshold: the lowest score at which precision, on all
candidates of held-out texts that no base span overlaps, is at least `precision`; a kind without one adds no span.
`held_out` reports precision and recall by kind.

Texts are worked on in segments of about SEGMENT characters, cut where no pattern can match across (behind a character or a blank that none of them takes there), so work grows
with the text, however many matches it holds. Only a stretch without any such place is one longer segment, and costs the square of the candidates in it.

Positions are code points, ends exclusive. Edge cases: null text is empty and has no spans; repeated rows are
judged row by row; ties in score go to the earlier, then the longer span, then the kind first by name; an empty table gives no rows; extra
columns stay out, and `redact` changes text (and n_chars, if there is one) only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
ADDED = ("number", "secret", "handle")
# The base patterns; possessive where that changes no match, and tried only where a run of their first class begins or a match has just ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "number": r"(?:\G|(?<![0-9A-Za-z]))[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
    "secret": r"(?:\G|(?<![A-Za-z0-9_+/=-]))[A-Za-z0-9_+/=-]{16,}+",
    "handle": r"(?:\G|(?<![^\x20\x09-\x0D\"'<>(),;:]))[^\x20\x09-\x0D\"'<>(),;:@]++@[^\x20\x09-\x0D\"'<>(),;:@]++",
}
# What a text must hold for a pattern to match at all: cheap to look for before the pattern runs.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "number": "[0-9]", "secret": "[0-9]", "handle": "@"}
NAMED = r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|ssn|iban|account|phone|tel|mobile|e-?mail|contact|card)\W{0,6}$"
AGREEING = 0.3
SPAN = "struct<kind:string,s:int,e:int>"
SEGMENT, BLOCK = 2000, 256
UNIT, BUCKETS = float(1 << 26), 64  # parts of a gradient, and buckets of scores a unit
CUT = rf"(?s).{{{SEGMENT}}}.*?(?:[\x09-\x0D,;\"'<>:]|(?<=[^\x20().0-9-])\x20)|(?s).+"  # no match holds these characters, nor a blank behind one that is not of a number
FEATURES = ("length", "digits", "letters", "uppers", "hexes", "separators", "groups", "mixes", "distinct", "quoted", "assigned", "glued", "generator")


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of all matches: lengths of what stands between them, and of themselves, add up to positions. Sums run in blocks, shifted by
    those before, as each step copies the list it adds to."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.char_length(g).alias("gap"), F.char_length(m).alias("n")))
    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def step(acc, x):
        s = acc["at"] + x["gap"]
        return F.struct((s + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["m"].alias("m")))).alias("out"))

    def joined(acc, block):
        more = F.transform(block["out"], lambda x: F.struct((x["s"] + acc["at"]).alias("s"), (x["e"] + acc["at"]).alias("e"), x["m"].alias("m")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(more)).alias("out"))

    none = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    in_blocks = F.transform(F.array(pairs), lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(p), F.lit(1)) - 1) / BLOCK).cast("int")), lambda i: F.aggregate(F.slice(p, i * BLOCK + 1, F.lit(BLOCK)), none, step)))[0]
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,e:int,m:string>>>").alias("out"))
    return F.aggregate(in_blocks, start, joined, lambda acc: F.flatten(acc["out"]))


def searched(text: Column, name: str, pattern: str) -> Column:
    """The matches of a pattern in texts that pass its gate, none in others."""
    gate = F.contains(text, F.lit("@")) if GATES[name] == "@" else text.rlike(GATES[name])
    return F.when(gate, matches(text, pattern)).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m pass the check sum."""
    d = F.reverse(_digits(m))
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(d), F.lit(1))), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, F.substr(d, i, F.lit(1)).cast("int")).otherwise(F.substr(F.lit("0246813579"), F.substr(d, i, F.lit(1)).cast("int") + 1, F.lit(1)).cast("int")))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.char_length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.when(F.char_length(F.regexp_replace(p, "^0+", "")) <= 3, F.regexp_replace(p, "^0+(?=.)", "").cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(m)).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def segmented(docs: DataFrame) -> DataFrame:
    """Add `_text` and `_parts`: its segments (at, before, text, after) with the 16 characters before and the one after."""
    texts = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("_cut", F.regexp_extract_all("_text", F.lit(CUT), F.lit(0)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    places = F.aggregate("_cut", start, lambda acc, x: F.struct((acc["at"] + F.char_length(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    n = F.size("_cut")
    before = F.slice(F.concat(F.array(F.lit("")), F.transform("_cut", lambda x: F.right(x, F.lit(16)))), 1, n)
    after = F.slice(F.concat(F.transform("_cut", lambda x: F.left(x, F.lit(1))), F.array(F.lit(""))), 2, n)
    named = texts.withColumns({"_at": places, "_before": before, "_after": after})
    parts = F.transform(F.arrays_zip("_at", "_before", "_cut", "_after"), lambda x: F.struct(x["_at"].alias("at"), x["_before"].alias("before"), x["_cut"].alias("text"), x["_after"].alias("after")))
    return named.withColumn("_parts", parts).drop("_cut", "_at", "_before", "_after")


def with_fields(part: Column, *names: str, **more: Column) -> Column:
    return F.struct(*[part[n].alias(n) for n in names], *[c.alias(n) for n, c in more.items()])


PLACE = ("at", "before", "text", "after")


def with_base(docs: DataFrame) -> DataFrame:
    """Add `_text` and `_parts`: segments with `base`, an array of (kind, s, e), by kind and start within the segment."""

    def spans(part: Column, kind: str) -> Column:
        return F.transform(F.filter(part[kind], lambda x: _valid(kind, x["m"])), lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))

    found = segmented(docs).withColumn("_parts", F.transform("_parts", lambda p: with_fields(p, *PLACE, **{k: searched(p["text"], k, PATTERNS[k]) for k in KINDS})))
    return found.withColumn("_parts", F.transform("_parts", lambda p: with_fields(p, *PLACE, base=F.concat(*[spans(p, k) for k in KINDS]))))


def with_candidates(based: DataFrame) -> DataFrame:
    """Add to each segment `candidates`: array of spans with FEATURES and the sources of their labels: whether a base span covers or overlaps them, and whether they are named."""

    def described(part: Column, name: str, code: int) -> Column:
        base = part["base"]

        def around(x):
            before = F.right(F.concat(part["before"], F.substr(part["text"], F.greatest(x["s"] - 15, F.lit(1)), F.least(x["s"], F.lit(16)))), F.lit(16))
            after = F.substr(F.concat(part["text"], part["after"]), x["e"] + 1, F.lit(1))
            return with_fields(x, "s", "e", "m", before=before, after=after)

        def one(x):
            m, before, after = x["m"], x["before"], x["after"]
            count = lambda c: F.char_length(F.regexp_replace(m, f"[^{c}]", "")).cast("double")
            flag = lambda c: c.cast("double")
            over = F.exists(base, lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"]))
            inside = F.exists(base, lambda b: (b["s"] <= x["s"]) & (b["e"] >= x["e"]))
            named = before.rlike(NAMED)
            return F.struct(
                F.lit(name).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), over.alias("over"), inside.alias("inside"), named.alias("named"),
                F.char_length(m).cast("double").alias("length"), count("0-9").alias("digits"), count("A-Za-z").alias("letters"), count("A-Z").alias("uppers"), count("0-9a-f").alias("hexes"), count(r"\x20().@_+/=-").alias("separators"),
                F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))).cast("double").alias("groups"), F.size(F.array_distinct(F.split(m, ""))).cast("double").alias("distinct"),
                F.size(F.regexp_extract_all(m, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]"), F.lit(0))).cast("double").alias("mixes"),
                flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).alias("quoted"), flag(before.rlike("[=:]\\W{0,3}$")).alias("assigned"), flag(before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]")).alias("glued"), F.lit(float(code)).alias("generator"),
            )

        return F.transform(F.transform(F.filter(part[name], lambda x: x["m"].rlike("[0-9@]")), around), one)

    found = based.withColumn("_parts", F.transform("_parts", lambda p: with_fields(p, *PLACE, "base", **{n: searched(p["text"], n, g) for n, g in GENERATORS.items()})))
    return found.withColumn("_parts", F.transform("_parts", lambda p: with_fields(p, "at", "text", "base", candidates=F.concat(*[described(p, n, i) for i, n in enumerate(GENERATORS)]))))


def in_text(spans: str) -> Column:
    """The spans of all segments, in order of these, at their places in the text."""
    return F.flatten(F.transform("_parts", lambda p: F.transform(p[spans], lambda x: F.struct(x["kind"].alias("kind"), (x["s"] + p["at"]).alias("s"), (x["e"] + p["at"]).alias("e")))))


class Boosted:
    """Gradient-boosted regression trees on the log-odds, of depth two."""

    def __init__(self, rounds: int = 30, rate: float = 0.3):
        self.rounds, self.rate, self.base, self.trees = rounds, rate, 0.0, []

    @staticmethod
    def _splits(rows: DataFrame, side: Column) -> dict[int, dict]:
        """The best split of each side's rows, with the sums left of it and in all: of equal gains that of the first feature, then of the least value."""
        each = rows.select(side.alias("side"), "g", "h", F.posexplode(F.array(*FEATURES)).alias("j", "v"))
        sums = each.groupBy("side", "j", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        of = Window.partitionBy("side", "j")
        up_to = of.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        totals = {f"{name}{x}": F.sum(x).over(w) / UNIT for name, w in (("left_", up_to), ("all_", of)) for x in ("g", "h")}
        cuts = sums.withColumns(totals | {"next": F.lead("v").over(of.orderBy("v"))})
        term = lambda g, h: g * g / (h + 1)
        lg, lh, g, h = (F.col(x) for x in ("left_g", "left_h", "all_g", "all_h"))
        gain = F.when(F.col("next").isNotNull(), term(lg, lh) + term(g - lg, h - lh) - term(g, h)).otherwise(0.0)
        ranked = F.struct(gain.alias("gain"), (-F.col("v")).alias("_v"), ((F.col("v") + F.col("next")) / 2).alias("cut"), lg, lh, g, h)
        best = {}
        for r in sorted(cuts.groupBy("side", "j").agg(F.max(ranked).alias("best")).collect(), key=lambda r: r["j"]):
            if r["side"] not in best or r["best"]["gain"] > best[r["side"]]["gain"]:
                best[r["side"]] = r["best"].asDict() | {"j": r["j"]}
        return best

    def _leaf(self, g: float, h: float) -> float:
        return self.rate * g / (h + 1)

    def _tree(self, rows: DataFrame):
        root = self._splits(rows, F.lit(0))[0]
        if root["gain"] <= 1e-6:
            return self._leaf(root["all_g"], root["all_h"])
        sides = self._splits(rows, F.when(F.col(FEATURES[root["j"]]) < root["cut"], 0).otherwise(1))

        def grown(b):
            if b["gain"] <= 1e-6:
                return self._leaf(b["all_g"], b["all_h"])
            return (b["j"], b["cut"], self._leaf(b["left_g"], b["left_h"]), self._leaf(b["all_g"] - b["left_g"], b["all_h"] - b["left_h"]))

        return (root["j"], root["cut"], grown(sides[0]), grown(sides[1]))

    def fit(self, rows: DataFrame) -> Boosted:
        """Learn from all rows: FEATURES, y (0 or 1), and n, the number of candidates like that."""
        share = rows.agg(F.sum(F.col("n") * F.col("y")) / F.sum("n")).first()[0]
        share = min(max(share, 1e-3), 1 - 1e-3)
        self.base = math.log(share / (1 - share))
        features = {name: F.col(name) for name in FEATURES}
        f = F.lit(self.base)
        whole = lambda x: F.round(x * UNIT).cast("long") * F.col("n")
        for _ in range(self.rounds):
            p = 1 / (1 + F.exp(-F.col("f")))
            self.trees.append(self._tree(rows.withColumn("f", f).select(*FEATURES, whole(F.col("y") - p).alias("g"), whole(p * (1 - p)).alias("h"))))
            f = f + self._of(self.trees[-1], features)
        return self

    def _of(self, tree, candidate) -> Column:
        return F.lit(tree) if not isinstance(tree, tuple) else F.when(candidate[FEATURES[tree[0]]] < tree[1], self._of(tree[2], candidate)).otherwise(self._of(tree[3], candidate))

    def column(self, candidate: Column | dict[str, Column]) -> Column:
        out = F.lit(self.base)
        for tree in self.trees:
            out = out + self._of(tree, candidate)
        return out


FORMAT = ("generator", "length", "separators", "has_digits", "has_letters", "has_uppers", "all_hex")


def weak_labels(counts: DataFrame) -> DataFrame:
    """Add y, whether candidates count as personal: by their own sources, or because of at least three others of their format a share of
    AGREEING is named. A format that checked spans have gets nothing from agreement: its other candidates failed the check."""
    shaped = counts.withColumns({f"has_{c}": F.col(c) > 0 for c in ("digits", "letters", "uppers")} | {"all_hex": F.col("hexes") == F.col("length")})
    formats = shaped.groupBy(*FORMAT).agg(F.sum("n").alias("times"), F.sum(F.when(F.col("named"), F.col("n")).otherwise(0)).alias("agreed"), F.max("inside").alias("checked"))
    agreeing = ~F.col("checked") & (F.col("times") > 3) & (F.col("agreed") - F.col("named").cast("long") >= AGREEING * (F.col("times") - 1))
    return shaped.join(formats, list(FORMAT)).select(*counts.columns, (F.col("named") | F.col("inside") | agreeing).cast("int").alias("y"))


def described(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """docs with `_hash` of the text and `_parts`, segments of the fields to keep and their candidates; stored, so the regular expressions run once. The
    text itself stays only if it is one of these fields."""
    found = with_candidates(with_base(docs))
    parts = F.transform("_parts", lambda p: with_fields(p, *keep, "candidates"))
    return stored(found.select(*[c for c in docs.columns if c != "text" or c in keep], F.xxhash64("_text").alias("_hash"), parts.alias("_parts")), "described")


def counted(found: DataFrame) -> DataFrame:
    """How many candidates of all distinct texts are alike: FEATURES, kind, inside, named, over, part of the texts, and n."""
    parts = found.select("_hash", F.explode("_parts").alias("p")).select("_hash", F.col("p.at").alias("at"), F.explode("p.candidates").alias("c"))
    what = [*FEATURES, "kind", "inside", "named", "over"]
    distinct = parts.select("_hash", (F.col("at") + F.col("c.s")).alias("s"), (F.col("at") + F.col("c.e")).alias("e"), *[f"c.{x}" for x in what]).distinct()
    return distinct.groupBy(*what, F.pmod("_hash", F.lit(3)).alias("part")).agg(F.count("*").alias("n"))


def held_out(docs: DataFrame, precision: float = 0.9) -> dict[str, dict[str, float]]:
    """For each added kind that has a threshold: precision, recall and number of held-out candidates at it."""
    learned = fit(counted(described(docs, ("at",))), precision)
    return learned[2] if learned else {}


def limits(scored: DataFrame, precision: float) -> list[Row]:
    """For each kind the lowest score down to which precision is reached, with counts (n, true) down to it and in all, from kind, score, n and y. Counts run
    within buckets of scores, shifted by those of the buckets above."""
    by = scored.groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("true")).withColumn("bucket", F.floor(F.col("score") * BUCKETS))
    above = Window.partitionBy("kind").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = by.groupBy("kind", "bucket").agg(F.sum("n").alias("n"), F.sum("true").alias("true"))
    shifts = buckets.select("kind", "bucket", *[F.coalesce(F.sum(x).over(above), F.lit(0)).alias(f"{x}_above") for x in ("n", "true")])
    inside = Window.partitionBy("kind", "bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = by.join(shifts, ["kind", "bucket"]).select("kind", "score", *[(F.col(f"{x}_above") + F.sum(x).over(inside)).alias(x) for x in ("n", "true")])
    good = F.when(F.col("true") / F.col("n") >= precision, F.struct("score", "n", "true"))
    return down.groupBy("kind").agg(F.min(good).alias("least"), F.max("n").alias("n"), F.max("true").alias("true")).collect()


def fit(counts: DataFrame, precision: float = 0.9) -> tuple[Boosted, dict[str, float], dict] | None:
    """(trees, threshold by kind, held-out figures by kind) learned from all candidates, as counted; None: nothing to add."""
    labelled = stored(weak_labels(stored(counts, "candidates")), "labelled")
    taught = labelled.where("part > 0").groupBy(*FEATURES, "y").agg(F.sum("n").alias("n"))
    if (labelled.agg(F.sum("n")).first()[0] or 0) < 60 or taught.select("y").distinct().count() < 2:
        return None
    model, thresholds, figures = Boosted().fit(stored(taught, "taught")), {}, {}
    held = labelled.where((F.col("part") == 0) & ~F.col("over")).select("kind", model.column({name: F.col(name) for name in FEATURES}).alias("score"), "n", "y")
    for r in limits(held, precision):
        if r["n"] >= 5 and r["least"]:
            least = r["least"]
            thresholds[r["kind"]] = least["score"]
            figures[r["kind"]] = {"precision": least["true"] / least["n"], "recall": least["true"] / r["true"], "candidates": r["n"]}
    return (model, thresholds, figures) if thresholds else None


def with_spans(docs: DataFrame, precision: float = 0.9, keep: tuple[str, ...] = ("at", "text", "base")) -> DataFrame:
    """docs with `_parts`: segments (those of keep, and added); added are the method's spans, by kind and start."""
    found = described(docs, keep)
    learned = fit(counted(found), precision)
    if learned is None:
        return found.withColumn("_parts", F.transform("_parts", lambda p: with_fields(p, *keep, added=F.array().cast(f"array<{SPAN}>"))))
    model, thresholds, _ = learned
    least = F.create_map(*[F.lit(x) for kind, score in thresholds.items() for x in (kind, -score)])

    def ranked(part):
        scored = F.transform(F.filter(part["candidates"], lambda c: ~c["over"]), lambda c: F.struct((-model.column(c)).alias("rank"), c["s"].alias("s"), (-c["e"]).alias("_e"), c["e"].alias("e"), c["kind"].alias("kind")))
        return F.array_sort(F.filter(scored, lambda c: c["rank"] <= least[c["kind"]]))

    def chosen(part):
        return F.aggregate(part["ranked"], F.array().cast(f"array<{SPAN}>"), lambda acc, c: F.when(F.exists(acc, lambda a: (a["s"] < c["e"]) & (a["e"] > c["s"])), acc).otherwise(F.concat(acc, F.array(F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"))))))

    found = found.withColumn("_parts", F.transform("_parts", lambda p: with_fields(p, *keep, ranked=ranked(p))))
    found = found.withColumn("_parts", F.transform("_parts", lambda p: with_fields(p, *keep, chosen=chosen(p))))
    return found.withColumn("_parts", F.transform("_parts", lambda p: with_fields(p, *keep, added=F.array_sort(p["chosen"]))))


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, their digest, and all spans."""
    found = with_spans(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), keep=("at", "base"))
    spans = found.select("doc_id", in_text("base").alias("base"), in_text("added").alias("added"))
    listed = lambda name, kinds: F.concat(*[of_kind(name, kind) for kind in kinds])
    return spans.select(
        "doc_id", *[F.size(of_kind("base", kind)).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(spans_text(listed("base", KINDS)), 256).alias("base_sha256"), spans_text(F.concat(listed("base", KINDS), listed("added", ADDED))).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; texts without a span stay as they are."""
    names = docs.columns
    inner = docs.select(*[F.col(c).alias(c if c == "text" else f"c{i}") for i, c in enumerate(names)])
    spanned = with_spans(inner)

    def cleaned(part):
        ordered = F.array_sort(F.transform(F.concat(part["base"], part["added"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

        def step(acc, x):
            grown = F.concat(acc["out"], F.array(F.substr(part["text"], acc["at"] + 1, x["s"] - acc["at"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))
            return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], grown).otherwise(acc["out"]).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(part["text"], acc["at"] + 1, F.char_length(part["text"]))))

    some = F.exists("_parts", lambda p: F.size(p["base"]) + F.size(p["added"]) > 0)
    new = F.when(some, F.array_join(F.transform("_parts", cleaned), "")).otherwise(F.col("text"))
    done = spanned.withColumn("text", new)
    return done.select(*[(F.when(F.col(f"c{i}").isNotNull(), F.char_length("text").cast(docs.schema[i].dataType)) if c == "n_chars" else F.col("text") if c == "text" else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])
