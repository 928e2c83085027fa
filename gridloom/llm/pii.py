"""Personal data by candidate boosting. DataFrame functions only.

High-recall patterns propose overlapping spans. Fixed base rules keep some of them outright. The rest is scored by
boosted trees over format and context features. Labels do not come from the base patterns alone: outside base spans a
proposal is right if its format is valid and it stands alone (a phone number without '+' also needs a word such as call
before it), wrong if not; what has only a part of that has no label. Examples of a fixed-seed grammar are added, so that
every form is known where the corpus has few. The trees are fitted on a bounded sample of distinct candidates, the same
share for each kind and label; all other labelled candidates calibrate, per kind, the lowest score that still has the
wanted precision. The fitted trees become one column expression, so texts are read once, no row
is shuffled and nothing runs in Python.
"""

from __future__ import annotations

import random
import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.lineage import cut_lineage
from gridloom.llm.common import free_name, written

KINDS = ["email", "ip", "card", "phone"]
#: Fixed patterns. The look-behinds and possessive marks only spare Java a second look at the same characters; the
#: matches are those of the plain patterns. A card's digit run is taken whole, so runs under 14 digits need no match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider proposals: written-out addresses, card numbers inside longer digit runs, national telephone formats.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[A-Za-z0-9-]{1,63}){1,8}",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|(?<![0-9]-)[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
CONTEXT = r"mail|contact|kontakt|phone|tel\b|call|fax|mobil|address|host|server|\bip\b|card|visa|credit|account|konto|pay"
CONTEXT_CHARS = 24
#: Bound of the labelled sample the trees are fitted on, drawn from all distinct candidates by a hash.
MAX_SAMPLE = 20_000
TREES, DEPTH = 10, 3
#: Precision that a kind's threshold must have on the candidates not fitted on, and the distinct right ones it must rest on.
PRECISION, LEAST_HELD_OUT = 0.99, 5
#: Steps of the score by which the candidates not fitted on are counted.
STEPS = 1000
BLOCK = 256
#: Code points of a block from which the redacted text is put together.
CUT = 4096
FEATURES = ["kind", "length", "digits", "luhn", "plus", "octets", "at", "breaks", "joined_before", "joined_after", "context", "distinct_digits", "valid", "continued"]


def _running(values: str, start: str, step: str) -> str:
    """SQL: inclusive running totals of an array of longs, in blocks, so that long arrays stay far from quadratic.

    `start` is the total of nothing, `step` the total of `a` and `v`.
    """
    last = "element_at(t, -1)"
    blocks = f"transform(sequence(0, int(greatest(0, ceil(size({values}) / {BLOCK}) - 1))), b -> slice({values}, b * {BLOCK} + 1, {BLOCK}))"
    added = step.replace("(a, v)", f"({last}, v)").replace("a + v", f"{last} + v")
    totals = f"transform({blocks}, x -> aggregate(x, {start}, (a, v) -> {step}))"
    before = f"aggregate({totals}, array({start}), (t, v) -> concat(t, array({added})))"
    return f"flatten(zip_with({blocks}, slice({before}, 1, size({blocks})), (x, s) -> slice(aggregate(x, array(s), (t, v) -> concat(t, array({added}))), 2, {BLOCK})))"


def _sums(values: str) -> str:
    return _running(values, "0L", "a + v")


def _tops(values: str) -> str:
    return _running(values, "-1L", "greatest(a, v)")


def _luhn(digits: str) -> str:
    d = f"int(substr({digits}, i, 1))"
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + if((length({digits}) - i) % 2 = 0, {d}, if({d} > 4, 2 * {d} - 9, 2 * {d}))) % 10 = 0"


def _hits(df: DataFrame, text: str, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds for each (pattern, guard) an array of (start, end, hit, before, after): leftmost matches, code points, end exclusive.

    `before` and `after` are the characters beside a match, taken from the gaps and matches next to it, so that no text
    is searched for a position.
    """
    cols = {}
    for name, (pattern, guard) in patterns.items():
        wanted = F.expr(guard)
        cols[f"{name}_m"] = F.when(wanted, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = df.withColumns(cols)
    cols = {n + "_g": F.when(F.size(n + "_m") > 0, F.split(text, p, -1)).otherwise(F.array().cast("array<string>")) for n, (p, _) in patterns.items()}
    df = df.withColumns(cols)
    cols = {n + "_s": F.expr(f"transform({n}_m, (m, i) -> length({n}_g[i]) + if(i = 0, 0L, bigint(length(get({n}_m, i - 1)))))") for n in patterns}
    df = df.withColumns(cols)
    empty = "cast(array() as array<struct<start: bigint, end: bigint, hit: string, before: string, after: string>>)"
    cols = {}
    for n in patterns:
        # the gap and match before, the gap and match after: neighbours in the arrays
        before = f"right(concat(if(i = 0, '', right(get({n}_m, i - 1), {CONTEXT_CHARS})), right({n}_g[i], {CONTEXT_CHARS})), {CONTEXT_CHARS})"
        after = f"left(concat(left(get({n}_g, i + 1), 2), coalesce(left(get({n}_m, i + 1), 2), '')), 2)"
        beside = f"transform({n}_m, (m, i) -> struct(m, {before} as before, {after} as after))"
        cols[n] = F.expr(f"if(size({n}_m) = 0, {empty}, zip_with({_sums(n + '_s')}, {beside}, (s, x) -> struct(s as start, s + length(x.m) as end, x.m as hit, x.before as before, x.after as after)))")
    return df.withColumns(cols).drop(*[n + x for n in patterns for x in ("_m", "_g", "_s")])


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds pii_base, an array of (start, kind, end), and pii_found, all proposals with their features and a label.

    The label is 1 for a base span, null for what else touches one, and for the rest as the evidence of format and
    context has it. Null texts are empty.
    """
    df = docs.withColumn("pii_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("pii_digits", F.rlike("pii_text", F.lit("[0-9]")))
    guards = {"email": "contains(pii_text, '@')", "ip": "pii_digits", "card": "pii_digits", "phone": "pii_digits and contains(pii_text, '+')"}
    wide_guards = {"email": "contains(pii_text, 'at)') or contains(pii_text, 'at]') or contains(pii_text, 'at )') or contains(pii_text, 'at ]')", "card": "pii_digits", "phone": "pii_digits"}
    names = {f"pii_b_{k}": (BASE[k], guards[k]) for k in KINDS} | {f"pii_w_{k}": (WIDE[k], wide_guards[k]) for k in WIDE}
    df = _hits(df, "pii_text", names)
    digits = "regexp_replace({0}.hit, '[^0-9]', '')"
    valid = {
        "email": "true", "ip": f"x.hit rlike '{OCTETS}'",
        "card": f"length({digits.format('x')}) between 14 and 19 and {_luhn(digits.format('x'))}",
        "phone": f"length({digits.format('x')}) between 10 and 15",
    }
    sql = lambda s: s.replace("\\", "\\\\")
    rows = []
    for n in names:
        # of equal spans the base one sorts first and stays
        other = f"int(not ({sql(valid[n[6:]])}))" if n.startswith("pii_b_") else "1"
        rows.append(f"transform({n}, x -> struct({KINDS.index(n[6:])} as kind, x.start as start, x.end as end, {other} as other, x.hit as hit, x.before as before, x.after as after))")
    df = df.withColumn("pii_sorted", F.expr(f"array_sort(concat({', '.join(rows)}))"))
    distinct = "i = 0 or get(pii_sorted, i - 1).kind != x.kind or get(pii_sorted, i - 1).start != x.start or get(pii_sorted, i - 1).end != x.end"
    df = df.withColumn("pii_all", F.expr(f"filter(pii_sorted, (x, i) -> {distinct})"))
    df = df.withColumn("pii_base", F.expr("array_sort(transform(filter(pii_all, x -> x.other = 0), x -> struct(x.start as start, x.kind as kind, x.end as end)))"))
    # sweeps: how far the base spans reach that start before a proposal ends, and those that start where it does or before
    for name, key, base_turn in (("pii_reach", "end", 1), ("pii_cover", "start", 0)):
        proposals = f"transform(pii_all, (x, i) -> struct(x.{key} as key, {1 - base_turn} as turn, -1L as reach, i as place))"
        events = f"array_sort(concat(transform(pii_base, b -> struct(b.start as key, {base_turn} as turn, b.end as reach, -1 as place)), {proposals}))"
        df = df.withColumn("pii_events", F.expr(events)).withColumn("pii_ends", F.expr("transform(pii_events, e -> e.reach)"))
        far = f"zip_with(pii_events, {_tops('pii_ends')}, (e, t) -> struct(e.place as place, t as top))"
        df = df.withColumn(name, F.expr(f"transform(array_sort(filter({far}, p -> p.place >= 0)), p -> p.top)")).drop("pii_events", "pii_ends")
    d = digits.format("x")
    one = lambda c: f"double({c})"
    # a written-out address without a sentence's end in it, a card of 13 digits that starts with 4, a national number
    right = f"""(case x.kind when {KINDS.index('email')} then contains(x.hit, '@') or x.hit rlike '[A-Za-z]{{2,24}}$' and not x.hit rlike '[.] '
        when {KINDS.index('ip')} then x.hit rlike '{sql(OCTETS)}'
        when {KINDS.index('card')} then length({d}) between 13 and 19 and (length({d}) > 13 or startswith({d}, '4')) and {_luhn(d)}
        else startswith(x.hit, '+') and length({d}) between 10 and 15 or {d} rlike '^(?:[2-9][0-9]{{2}}[2-9][0-9]{{6}}|0[1-9][0-9]{{7,9}})$' end)"""
    # a whole valid card number is one beside other digits too
    joined = """(x.kind != 2 and (right(x.before, 2) rlike '[0-9][ .-]?$'
        or x.kind > 1 and not startswith(x.hit, '+') and x.after rlike '^[ -]?[0-9]'))"""
    features = {
        "kind": one("x.kind"), "length": one("x.end - x.start"), "digits": one(f"length({d})"), "luhn": one(f"int(length({d}) >= 12 and length({d}) <= 19 and {_luhn(d)})"),
        "plus": one("int(startswith(x.hit, '+'))"), "octets": one(f"int(x.hit rlike '{sql(OCTETS)}')"), "at": one("int(contains(x.hit, '@'))"),
        "breaks": one("length(regexp_replace(x.hit, '[^ .()-]', ''))"),
        "joined_before": one("int(right(x.before, 1) rlike '[A-Za-z0-9]')"),
        "joined_after": one("int(left(x.after, 1) rlike '[A-Za-z0-9]')"),
        "context": one(f"int(lower(x.before) rlike '{sql(CONTEXT)}')"),
        "distinct_digits": one(f"size(array_distinct(split({d}, '')))"),
        "valid": one(f"int({right})"), "continued": one(f"int({joined})"),
    }
    sure = f"{right} and not {joined} and (x.kind != {KINDS.index('phone')} or startswith(x.hit, '+') or {features['context']} = 1)"
    evidence = f"when {sure} then 1.0D when not {right} or {joined} then 0.0D else null"
    fields = ", ".join(f"{v} as f_{k}" for k, v in features.items())
    label = f"case when z.pii_all.other = 0 then 1.0D when z.pii_reach > z.pii_all.start then null {evidence} end"
    found = f"struct(x.kind as kind, x.start as start, x.end as end, {label} as label, z.pii_cover >= x.end as inside, xxhash64(x.hit) as pick, {fields})"
    found = re.sub(r"\bx\.(?=(?:kind|start|end|hit|before|after)\b)", "z.pii_all.", found)
    df = df.withColumn("pii_found", F.expr(f"transform(arrays_zip(pii_all, pii_reach, pii_cover), z -> {found})"))
    return df.drop("pii_text", "pii_digits", "pii_sorted", "pii_all", "pii_reach", "pii_cover", *names)


def _tree(node, c: Column) -> Column:
    """A fitted regression tree as nested conditions over the features of `c`."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    feature = c[f"f_{FEATURES[split.featureIndex()]}"]
    return F.when(feature <= F.lit(float(split.threshold())), _tree(node.leftChild(), c)).otherwise(_tree(node.rightChild(), c))


class Model:
    """Boosted trees and a threshold per kind; a kind without threshold adds nothing."""

    def __init__(self, trees: list, thresholds: dict[int, float]):
        self.trees, self.thresholds = trees, thresholds

    def margin(self, c: Column) -> Column:
        total = F.lit(0.0)
        for weight, root in self.trees:
            total = total + F.lit(weight) * _tree(root, c)
        return total

    def chosen(self, c: Column) -> Column:
        limit = F.lit(None).cast("double")
        for kind, least in self.thresholds.items():
            limit = F.when(c["kind"] == kind, F.lit(least)).otherwise(limit)
        return F.coalesce(self.margin(c) >= limit, F.lit(False))


def grammar() -> list[str]:
    """Texts with each form of each kind, right and wrong, from a fixed seed."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abdegiklmnorstu") for _ in range(rnd.randrange(3, 9)))
    number = lambda n: str(rnd.randrange(10 ** (n - 1), 10**n))
    area = lambda: str(rnd.randrange(200, 1000))
    texts = []
    for _ in range(40):
        at, dot = rnd.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "(dot)")])
        lead = rnd.choice(["call", "phone", "fax", "contact"])
        texts += [f"{word()} {word()}{at}{word()}{dot}{rnd.choice(['com', 'org', 'net', 'de'])} {word()}", f"{word()} {word()} (at) {word()}. {word()} {word()}", f"{lead} ({area()}) {area()}-{number(4)} {word()}"]
        texts += [f"{lead} {area()}-{area()}-{number(4)} {word()}", f"{word()} {number(4)} {number(4)} {number(4)} {number(4)} {word()}", f"{word()} 1{number(2)}-{number(3)}-{number(4)} {word()}", f"{lead} +{rnd.randrange(1, 99)} {area()} {area()} {number(4)} {word()}"]
        card = "4" + number(11)
        check = next(c for c in "0123456789" if sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(card + c))) % 10 == 0)
        texts += [f"card {card}{check} {word()}", f"{word()} {card}{(int(check) + 1 + rnd.randrange(9)) % 10} {word()}", f"{word()} {word()}@{word()}.org {rnd.randrange(256)}.{rnd.randrange(256)}.1.{rnd.randrange(256)} {number(3)}.{number(3)}.999.1 {word()}"]
    return texts


def _labelled(found: DataFrame) -> DataFrame:
    return found.select(F.explode("pii_found").alias("c")).select("c.*").where(F.col("label").isNotNull())


def fit(found: DataFrame, max_sample: int = MAX_SAMPLE) -> Model:
    """Fits trees on at most `max_sample` distinct labelled candidates and thresholds on all others. Without both labels nothing is added."""
    spark = found.sparkSession
    examples = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in grammar()])).alias("text"))
    columns = [f"f_{k}" for k in FEATURES]
    order = ["pick", "kind", "label", *columns]
    # stored first: a filter pushed through the arrays would write their expressions out again and again
    examples = written(candidates(examples).select("pii_found"), "pii-examples")
    each = _labelled(found).select(*order).unionByName(_labelled(examples).select(*order))
    each = written(each.groupBy(*order).agg(F.count(F.lit(1)).alias("n")), "pii-labelled")
    strata = each.groupBy("kind", "label").count().collect()  # at most eight rows
    share = F.lit(0.0)
    for r in strata:
        share = F.when((F.col("kind") == r["kind"]) & (F.col("label") == r["label"]), F.lit(max_sample / (2 * len(KINDS) * r["count"]))).otherwise(share)
    fitted_on = (F.pmod("pick", F.lit(5)) != 0) & (F.pmod(F.xxhash64("pick", F.lit("draw")), F.lit(1_000_000)) < 1_000_000 * share)
    # the same rows in the same order whatever the partitioning, so the fit is repeatable
    sample = cut_lineage(each.where(fitted_on).orderBy(*order).limit(max_sample).coalesce(1))
    if sample.agg(F.count_distinct("label")).first()[0] < 2:
        return Model([], {})
    vectors = VectorAssembler(inputCols=columns, outputCol="features")
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, labelCol="label").fit(vectors.transform(sample).select("features", "label"))
    trees = [(float(w), t._call_java("rootNode")) for w, t in zip(fitted.treeWeights, fitted.trees)]
    model = Model(trees, {})
    step = F.floor(model.margin(F.struct(*columns)) * STEPS).alias("step")
    scored = each.where(~fitted_on).select("kind", "label", "n", step).groupBy("kind", "step")
    scored = scored.agg(F.sum(F.col("label") * F.col("n")).alias("right"), F.sum("n").alias("all"), F.sum("label").alias("distinct"))
    above = Window.partitionBy("kind").orderBy(F.col("step").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = scored.select("kind", "step", *[F.sum(c).over(above).alias(c) for c in ("right", "all", "distinct")])
    good = upto.where((F.col("right") >= PRECISION * F.col("all")) & (F.col("distinct") >= LEAST_HELD_OUT))
    model.thresholds = {r.kind: r.least / STEPS for r in good.groupBy("kind").agg(F.min("step").alias("least")).collect()}  # at most four rows
    return model


def _with_spans(found: DataFrame, model: Model) -> DataFrame:
    """Adds pii_spans: base spans and chosen candidates that lie in no span of the base, by start, kind and end."""
    added = F.filter("pii_found", lambda c: ~c["inside"] & model.chosen(c))
    added = F.transform(added, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return found.withColumn("pii_spans", F.array_sort(F.concat("pii_base", added)))


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; one row per row of `docs`.

    Null and empty texts have no spans; repeated rows give repeated rows, an empty table an empty one; further columns
    are ignored. Spans of different kinds may overlap, all are listed.
    """
    found = written(candidates(docs.select("doc_id", "text")).drop("text"), "pii-candidates")
    spans = _with_spans(found, fit(found, max_sample))
    counts = [F.expr(f"bigint(size(filter(pii_base, b -> b.kind = {i})))").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(_listed("pii_base"), 256).alias("base_sha256"), _listed("pii_spans").alias("spans"))


def redacted(docs: DataFrame, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """`docs`, all columns and rows, with every span of `text` replaced by its kind in brackets, such as [email].

    Overlapping spans become one, named by the first. Texts without spans, null ones included, stay as they are.
    """
    row = free_name(docs.columns, "row")
    packed = docs.select(F.struct("*").alias(row), F.col("text").alias("text"))
    found = written(candidates(packed).drop("text"), "pii-candidates")
    spans = _with_spans(found, fit(found, max_sample))
    text = f"{row}.text"
    spans = spans.withColumn("pii_ends", F.expr("transform(pii_spans, s -> s.end)")).withColumn("pii_tops", F.expr(_tops("pii_ends")))
    spans = spans.withColumn("pii_heads", F.expr("filter(zip_with(pii_spans, concat(array(-1L), slice(pii_tops, 1, greatest(0, size(pii_tops) - 1))), (s, t) -> struct(s, t)), z -> z.s.start >= z.t)"))
    ends = "concat(slice(transform(pii_heads, h -> h.t), 2, size(pii_heads)), array(array_max(pii_tops)))"
    spans = spans.withColumn("pii_merged", F.expr(f"if(size(pii_heads) = 0, cast(array() as array<struct<start: bigint, kind: int, end: bigint>>), zip_with(pii_heads, {ends}, (h, e) -> struct(h.s.start as start, h.s.kind as kind, e as end)))"))
    # a gap is cut from blocks of the text, so that no piece is searched from the text's first character on
    blocks = f"transform(sequence(0, int(length({text}) / {CUT})), b -> substring({text}, b * {CUT} + 1, {CUT}))"
    spans = spans.withColumn("pii_blocks", F.expr(f"if(size(pii_merged) = 0, array(), {blocks})")).withColumn("pii_gaps", F.expr(f"zip_with(concat(array(0L), transform(pii_merged, s -> s.end)), concat(transform(pii_merged, s -> s.start), array(bigint(length({text})))), (a, e) -> struct(a, e, int(a div {CUT}) as x, int(e div {CUT}) as y))"))
    inner = f"substring(get(pii_blocks, g.x), int(g.a % {CUT}) + 1, int(g.e - g.a))"
    outer = f"concat(substring(get(pii_blocks, g.x), int(g.a % {CUT}) + 1), array_join(slice(pii_blocks, g.x + 2, greatest(0, g.y - g.x - 1)), ''), substring(get(pii_blocks, g.y), 1, int(g.e % {CUT})))"
    names = ", ".join(f"'[{k}]'" for k in KINDS)
    pieces = f"zip_with(pii_gaps, pii_merged, (g, s) -> concat(if(g.x = g.y, {inner}, {outer}), coalesce(get(array({names}), s.kind), '')))"
    clean = F.expr(f"if(size(pii_merged) = 0, {text}, array_join({pieces}, ''))")
    return spans.withColumn("pii_clean", clean).select(*[(F.col("pii_clean") if c.lower() == "text" else F.col(row)[c]).alias(c) for c in docs.columns])
