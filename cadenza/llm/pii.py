"""Personal data by bootstrapped contextual extraction: what stands about known identifiers becomes lexical
patterns, patterns and instances are scored in turns until no pattern is added, and sure patterns find
identifiers of other forms. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import bound, table, written

SPACE, SOLID = r"\x20\x09-\x0D", r"[^\x20\x09-\x0D]"
#: The base form of each kind. Possessive and tied to where a run begins, they match what the
#: plain forms do in linear time.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = tuple(FORMS)
#: `secret` has no base form: its seeds are long runs of hex or base64 signs, which count only where a sure pattern is.
KINDS = (*BASE, "secret")
SECRET = r"^(?=.*[0-9])(?=.*[A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|[A-Za-z0-9+/_-]{32,}=*)$"
#: Stands for each character of a base span where candidates are looked for; no run reaches across it.
MASK = "\ue000"
APART = rf"{SPACE}=:\"'{MASK}"
#: What else may identify: a run that holds a digit or an @, `=`, `:` and quotes apart, with groups of digits after it
#: that single spaces part.
OTHER = rf"(?<![^{APART}])[^{APART}0-9@]*+[0-9@][^{APART}]*+(?:\x20[0-9][0-9().-]*+(?![^{SPACE}{MASK}\"'.,;!?#*$&%)\]>]))*+"
#: A candidate has this many characters.
LEAST_CHARS = 4
#: A pattern is made of words within this many characters about an instance.
REACH = 80
#: A pattern is sure with this many known instances, this share of them of one kind, and this share of its
#: occurrences in all texts before an identifier or candidate.
SUPPORT, SURE, OPEN = 3, 0.8, 0.5
SPAN = "array<struct<s:int,e:int,m:string,c:string,r:string>>"
#: Matches that are placed by an inner fold, whose array is copied with each.
LOT = 256


def matches(text: Column, form: str) -> Column:
    """array<struct<s,e,m,c,r>>: start and end (code points) of all matches, the match, what stands before and after it.

    Offsets are running lengths, folded a lot at a time, so the time grows with the matches, not their square.
    """
    parts = F.struct(F.split(text, form, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(form), F.lit(0)).alias("found"))

    def step(state: Column, pair: Column) -> Column:
        s = state["at"] + F.length(pair["g"])
        e = s + F.length(pair["m"])
        one = F.struct(s.alias("s"), e.alias("e"), pair["m"].alias("m"), F.substring(pair["g"], -REACH, REACH).alias("c"), F.substring(pair["r"], 1, REACH).alias("r"))
        return F.struct(e.alias("at"), F.array_append(state["out"], one).alias("out"))

    def lot(state: Column, pairs: Column) -> Column:
        start = F.struct(state["at"].alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))
        some = F.aggregate(pairs, start, step)
        return bound(some, lambda x: F.struct(x["at"].alias("at"), F.array_append(state["out"], x["out"]).alias("out")))

    def fold(p: Column) -> Column:
        n = F.size(p["found"])
        pairs = F.zip_with(
            F.zip_with(F.slice(p["gaps"], 1, n), p["found"], lambda g, m: F.struct(g.alias("g"), m.alias("m"))),
            F.slice(p["gaps"], 2, n),
            lambda x, r: F.struct(x["g"].alias("g"), x["m"].alias("m"), r.alias("r")),
        )
        lots = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / LOT).cast("int")), lambda k: F.slice(x, k * LOT + 1, F.lit(LOT)))
        start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out"))
        placed_ = bound(pairs, lambda x: F.aggregate(lots(x), start, lot, lambda state: F.flatten(state["out"])))
        return F.when(n > 0, placed_).otherwise(F.expr(f"cast(array() as {SPAN})"))

    return bound(parts, fold)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a digit string passes the check: every second digit from the right doubled, cross sums added."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def fits(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: bound(F.ltrim(p, F.lit("0")), lambda n: (F.length(n) < 3) | ((F.length(n) == 3) & (n <= "255"))))
    if kind == "card":
        return bound(digits(m), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The fitting matches of one kind; texts that lack its signs aren't searched."""
    signs = {
        "email": F.contains(text, F.lit("@")),
        "ip": F.regexp_like(text, F.lit(r"[0-9]\.[0-9]")),
        "card": F.regexp_like(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}")),
        "phone": F.contains(text, F.lit("+")),
    }
    none = F.expr(f"cast(array() as {SPAN})")
    return F.when(signs[kind], F.filter(matches(text, FORMS[kind]), lambda x: fits(kind, x["m"]))).otherwise(none)


def masked(text: Column, kind: str) -> Column:
    """text with MASK for each character of a fitting match of one kind; as long as before."""
    parts = F.struct(F.split(text, FORMS[kind], -1).alias("gaps"), F.regexp_extract_all(text, F.lit(FORMS[kind]), F.lit(0)).alias("found"))
    hidden = lambda g, m: F.concat(g, F.when(fits(kind, m), F.repeat(F.lit(MASK), F.length(m))).otherwise(m))
    whole = lambda p: F.concat(F.zip_with(F.slice(p["gaps"], 1, F.size(p["found"])), p["found"], hidden), F.array(F.element_at(p["gaps"], -1)))
    return bound(parts, lambda p: F.array_join(whole(p), ""))


def touches(x: Column, kind: str) -> Column:
    """Whether a candidate meets a span of one kind: of those that start before its end, the last is looked up by halving, as
    spans of a kind are in order and apart."""
    spans = F.col(kind)
    steps = F.filter(F.array(*[F.lit(1 << k) for k in reversed(range(31))]), lambda step: step <= F.size(spans))
    starts = lambda at: (at <= F.size(spans)) & (F.get(spans, at - 1)["s"] < x["e"])
    last = F.aggregate(steps, F.lit(0), lambda at, step: F.when(starts(at + step), at + step).otherwise(at))
    return F.when(F.size(spans) == 0, F.lit(False)).otherwise(F.coalesce(bound(last, lambda at: F.get(spans, at - 1)["e"]) > x["s"], F.lit(False)))


def trimmed(x: Column) -> Column:
    """A candidate without the punctuation about it."""
    core = F.regexp_extract(x["m"], r"(?s)[A-Za-z0-9@+](?:.*[A-Za-z0-9])?", 0)
    s = x["s"] + F.length(F.regexp_extract(x["m"], r"^([^A-Za-z0-9@+]*)", 1))
    return F.struct(s.alias("s"), (s + F.length(core)).alias("e"), core.alias("m"), x["c"].alias("c"), x["r"].alias("r"))


def words_of(x: Column) -> Column:
    """Words in lower case, digits as 0."""
    return F.filter(F.split(F.translate(F.lower(x), "123456789", "000000000"), rf"[{SPACE}]+"), lambda w: w != "")


def unmasked(words: Column) -> Column:
    """Words with null for each that holds a masked span."""
    return F.transform(words, lambda w: F.when(~F.contains(w, F.lit(MASK)), w))


def named(left: Column, before: Column, right: Column) -> Column:
    """The patterns of a place: the word before it and the one before that, the word before it if it ends in : or =,
    and the words on either side of it. Words that aren't there are null."""
    own = F.when(left.rlike("[^:=][:=]$"), F.concat(F.lit("1 "), left))
    return F.array_compact(F.array(F.concat(F.lit("2 "), before, F.lit(" "), left), own, F.concat(F.lit("b "), left, F.lit(" "), right)))


def patterns(context: Column, after: Column) -> Column:
    left = unmasked(words_of(F.regexp_replace(context, rf"[{SPACE}\"'(\[<]+$", "")))
    right = unmasked(words_of(F.regexp_replace(after, rf"^[\"')\]>.,;!?]+(?=[{SPACE}])", "")))
    return bound(left, lambda w: named(F.get(w, F.size(w) - 1), F.get(w, F.size(w) - 2), F.get(right, F.lit(0))))


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, h, email, ip, card, phone, other) of each row: base spans by kind, and other candidates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumns({k: base_spans(F.col("text"), k) for k in BASE})
    none = F.expr(f"cast(array() as {SPAN})")
    # candidates stand in the gaps between base spans
    rows = rows.withColumn("open", F.col("text"))
    for k in BASE:
        rows = rows.withColumn("open", F.when(F.size(k) > 0, masked(F.col("open"), k)).otherwise(F.col("open")))
    rows = rows.withColumn("other", F.when(F.regexp_like("open", F.lit("[0-9@]")), matches(F.col("open"), OTHER)).otherwise(none))
    # spans of different kinds may overlap, and the later one isn't masked then
    meets = lambda x: touches(x, "email") | touches(x, "ip") | touches(x, "card") | touches(x, "phone")
    kept = F.filter(F.transform("other", trimmed), lambda x: (F.length(x["m"]) >= LEAST_CHARS) & ~meets(x))
    return rows.select("doc_id", F.xxhash64("text").alias("h"), *BASE, kept.alias("other"))


def edges(rows: DataFrame) -> DataFrame:
    """(kind, seed, pattern, instance, doc_id, h, s, e) of every instance and its patterns.

    kind is that of a base form; seed is the kind as which an instance is known from the start, null for candidates.
    """

    def instances(spans: str, kind: Column) -> Column:
        return F.transform(
            spans,
            lambda x: F.struct(kind.alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("instance"), patterns(x["c"], x["r"]).alias("patterns")),
        )

    each = [*(instances(k, F.lit(k)) for k in BASE), instances("other", F.lit(None).cast("string"))]
    out = rows.select("doc_id", "h", F.explode(F.concat(*each)).alias("x")).select("doc_id", "h", "x.*")
    seed = F.coalesce("kind", F.when(F.col("instance").rlike(SECRET), F.lit("secret")))
    return out.select("kind", seed.alias("seed"), F.explode("patterns").alias("pattern"), "instance", "doc_id", "h", "s", "e")


def occurrences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern, all): in how many places of all texts each of the wanted patterns is, whatever stands there."""
    words = docs.where("text is not null").select(words_of(F.col("text")).alias("w"))
    places = F.transform("w", lambda x, i: named(F.get("w", i - 1), F.get("w", i - 2), F.get("w", i + 1)))
    each = words.select(F.explode(F.flatten(places)).alias("pattern"))
    return each.join(wanted.select("pattern"), "pattern").groupBy("pattern").agg(F.count("*").alias("all"))


def likely_patterns(graph: DataFrame, known: DataFrame, support: int, sure: float) -> DataFrame:
    """(pattern, kind, purity) of the patterns with enough known instances, nearly all of one kind by their scores."""
    per = graph.select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("score"), F.count("*").alias("n"))
    per = per.groupBy("pattern").agg(F.max(F.struct("score", "n", "kind")).alias("best"), F.sum("score").alias("total"))
    purity = F.col("best.score") / F.col("total")
    return per.where((F.col("best.n") >= support) & (purity >= sure)).select("pattern", "best.kind", purity.alias("purity"))


def sure_patterns(edge: DataFrame, docs: DataFrame, support: int = SUPPORT, sure: float = SURE, open_: float = OPEN) -> DataFrame:
    """(pattern, kind, score) of the patterns that can be trusted.

    A pattern's score is the share of its known instances, weighed by their scores, that are of its kind, times the
    share of its places in all texts in which an identifier or candidate stands. An instance's score is the
    likelihood that not all its sure patterns err; seeds have 1. Instances that sure patterns find are known in
    the next turn; turns end when no pattern is added. An instance counts once a pattern, however often it
    occurs. Texts are read anew only for patterns whose places haven't been counted.
    """
    graph = written(edge.groupBy("pattern", "instance").agg(F.min("seed").alias("seed"), F.count("*").alias("n")), "graph")
    ids = written(graph.groupBy("pattern").agg(F.sum("n").alias("ids"), F.count("*").alias("different")).where(F.col("different") >= support), "ids")
    graph = written(graph.join(ids.select("pattern"), "pattern"), "often")
    seeds = written(edge.where("seed is not null").groupBy("instance").agg(F.min("seed").alias("kind"), F.lit(1.0).alias("score")), "seeds")
    known, counted, before = seeds, None, 0
    while True:
        likely = written(likely_patterns(graph, known, support, sure), "likely")
        new = likely if counted is None else written(likely.join(counted, "pattern", "left_anti"), "new")
        if counted is None or not new.isEmpty():
            more = written(new.select("pattern").join(occurrences(docs, new), "pattern", "left"), "occurrences")
            counted = more if counted is None else counted.unionByName(more)
        share = F.col("ids") / F.greatest("ids", F.coalesce("all", F.lit(0)))
        good = likely.join(counted, "pattern").join(ids, "pattern").where(share >= open_).select("pattern", "kind", (F.col("purity") * share).alias("score"))
        good = written(good, "patterns")
        size = good.count()
        if size <= before:
            return good
        before = size
        gained = graph.where("seed is null").join(good, "pattern")
        err = F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))
        gained = gained.groupBy("instance", "kind").agg((1 - err).alias("score")).groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("x"))
        known = written(seeds.unionByName(gained.select("instance", "x.kind", "x.score")), "known")


def placed(spans: str, kind: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(kind.alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), x["k"]), x["s"], x["e"])), ",")


def personal_data(docs: DataFrame, support: int = SUPPORT, sure: float = SURE, open_: float = OPEN) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) of each row's whole text; null is empty.

    The counts and `base` are of the base forms, `spans` holds these and what sure patterns found besides,
    under the pattern's kind: arrays of struct<k, s, e>, k the kind's place in KINDS, sorted. Repeated rows
    each get their own; null doc_ids are like others; columns besides doc_id and text aren't read; an empty table gives no
    rows. Candidates are looked for between base spans, and the time for a text grows with its length times the logarithm
    of its spans.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    rows = written(found(docs), "found")
    edge = written(edges(rows), "edges")
    sure_ = sure_patterns(edge, docs, support, sure, open_)
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("by")).cast("int") - 1
    more = edge.where("kind is null").join(sure_.select("pattern", F.col("kind").alias("by"), "score"), "pattern")
    more = more.groupBy("doc_id", "h", "s", "e").agg(F.min(F.struct((-F.col("score")).alias("minus"), place.alias("k"))).alias("x")).select("doc_id", "h", "s", "e", "x.k")
    more = more.groupBy(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "h").alias("key")).agg(F.collect_list(F.struct("k", "s", "e")).alias("more"))
    base = F.concat(*[placed(k, F.lit(i)) for i, k in enumerate(BASE)])
    out = rows.select("doc_id", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "h").alias("key"), *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE], base.alias("base"))
    out = out.join(more, "key", "left")
    return out.select("doc_id", *[f"n_{k}" for k in BASE], "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
