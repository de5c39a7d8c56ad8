"""Information-theoretic sanitisation of personal data. DataFrame functions only.

Protected entities are the matches of four base patterns (e-mail, IP, card, phone). A term (a run
of letters, marks and digits) discloses an entity when the corpus says so: with p(.) as document
frequencies, the term's pointwise mutual information with the entity reaches the entity's
information content but for ``bits_kept`` bits, PMI(t, e) >= IC(e) - bits_kept, which is
p(e | t) >= 2**-bits_kept. With fewer than ``min_support`` mentions of the entity beside the term,
in different texts or at different places of one, p(e | t) is smoothed by one more document with the
term, which holds the entity with chance p(e): then terms found nowhere else disclose. Every occurrence
of such a term, in each document that holds the entity, is generalised to its shape's class
(``[word]``, ``[Name]``, ``[number]``), or removed where it leaves ``bits_removed`` bits at most;
entities become ``[email]`` etc.

Counting: entities and terms meet in whole documents. Copies of a text are counted as one text of
that many documents. Only pairs that could be flagged are made: the term's documents are at most
2**bits_kept times the entity's. p(t) counts every
document of the corpus that holds the term anywhere. Entities met in one text only disclose by the
same counts, so of those of a text two stand for the rest (of enough mentions, and of fewer).

Plans do not turn on sizes: the terms of all documents are counted by a shuffle of what each task
has counted, and joins are by key, but for keys of more than a thousandth of the joined rows (so at most a
thousand), which are broadcast.

Patterns are the contract's, made possessive and anchored at the start of a run (or the end of
the last match, \\G): the same leftmost greedy matches, without backtracking or deep recursion.

Defined results: null text is empty and has no spans; matches that fail a kind's test are
dropped without a retry; spans of different kinds may overlap; term spans never overlap base
spans; repeated rows each get a row; a text without entities gets no term spans, so clean
texts stay as they are; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

KINDS = ("email", "ip", "card", "phone", "term")
_octet = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
TERM = r"[\p{L}\p{M}\p{N}]+"
#: Matches that are placed together, see located().
SLICE = 256
MIN_SUPPORT = 2
BITS_KEPT = 1.0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_octet}(?:\.{_octet}){{3}}$")
    if kind == "card":
        return F.char_length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.char_length(_digits(m)).between(10, 15)
    return F.lit(True)


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


MATCHES = "array<struct<m:string,s:int,e:int>>"


def located(text: Column, pattern: str) -> Column:
    """MATCHES of the pattern: code points, end exclusive.

    Places come from the lengths of the pieces between matches, in slices that are moved afterwards,
    so that no step copies the whole list of a long text.
    """

    def place(a, z):
        s = a["at"] + z["g"]
        e = s + F.char_length(z["m"])
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(z["m"].alias("m"), s.alias("s"), e.alias("e")))).alias("out"))

    def shift(a, part):
        moved = F.transform(part["out"], lambda x: F.struct(x["m"].alias("m"), (x["s"] + a["at"]).alias("s"), (x["e"] + a["at"]).alias("e")))
        return F.struct((a["at"] + part["at"]).alias("at"), F.concat(a["out"], F.array(moved)).alias("out"))

    def placed(pairs):
        numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(pairs) / SLICE), F.lit(1)).cast("int") - 1)
        parts = F.transform(numbers, lambda i: F.aggregate(F.slice(pairs, i * SLICE + 1, F.lit(SLICE)), F.struct(F.lit(0).alias("at"), F.array().cast(MATCHES).alias("out")), place))
        return F.flatten(F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{MATCHES}>").alias("out")), shift)["out"])

    def paired(found):
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        return F.zip_with(gaps, found, lambda g, m: F.struct(F.char_length(g).alias("g"), m.alias("m")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: _let(paired(found), placed))


def tokens(text: Column) -> Column:
    """array<struct(term, s, e)> of the matches of TERM, lower-cased: code points, end exclusive."""
    return F.transform(located(text, TERM), lambda x: F.struct(F.lower(x["m"]).alias("term"), x["s"].alias("s"), x["e"].alias("e")))


def _base_matches(text: Column) -> Column:
    """array<struct(s, k, e, m)> of the valid matches of all kinds, in order."""
    parts = []
    for rank, kind in enumerate(KINDS[:4]):
        has = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else F.lit(True)
        if kind != "email":
            has = has & text.rlike("[0-9]")
        if kind == "card":
            has = text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")
        got = F.when(has, F.filter(located(text, PATTERNS[kind]), _test(kind))).otherwise(F.array().cast(MATCHES))
        parts.append(F.transform(got, _ranked(rank)))
    return F.array_sort(F.concat(*parts))


def _test(kind: str):
    return lambda x: _valid(kind, x["m"])


def _ranked(rank: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("k"), x["e"].alias("e"), x["m"].alias("m"))


def _uncovered(places: DataFrame, base: DataFrame) -> DataFrame:
    """The places (uid, s, e, ...) that overlap none of base (uid, s, e): running bounds over sorted rows."""
    kind = F.col("base_").cast("int").alias("b")
    rows = places.withColumn("base_", F.lit(False)).unionByName(base.withColumn("base_", F.lit(True)), allowMissingColumns=True).select("*", kind)
    back = Window.partitionBy("uid").orderBy("s", F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("uid").orderBy(F.desc("s"), "b").rowsBetween(Window.unboundedPreceding, 0)
    reach, nxt = F.max(F.when(F.col("base_"), F.col("e"))).over(back), F.min(F.when(F.col("base_"), F.col("s"))).over(ahead)
    rows = rows.withColumn("reach_", reach).withColumn("next_", nxt)
    apart = (F.coalesce("reach_", F.lit(0)) <= F.col("s")) & (F.coalesce("next_", F.col("e")) >= F.col("e"))
    return rows.where(~F.col("base_") & apart).select(*places.columns)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = MIN_SUPPORT, bits_kept: float = BITS_KEPT, bits_removed: float | None = None, with_text: bool = False) -> DataFrame:
    """One row per input row: id_col, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans,
    and with ``with_text`` the sanitised text."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    with C.Scratch(spark) as s:
        based = docs.withColumn("hits", _base_matches(F.col("text"))).withColumn("uid", F.monotonically_increasing_id())

        def entity(x):
            m = x["m"]
            return F.concat(x["k"].cast("string"), F.lit(":"), F.when(x["k"] == 0, F.lower(m)).when(x["k"] >= 2, _digits(m)).otherwise(m))

        # copies of a text share a key
        holds = F.size("hits") > 0
        kept = F.col("text") if with_text else F.when(holds, F.col("text"))
        base = F.transform("hits", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
        found = s.write(based.select("id", "uid", base.alias("base"), F.when(holds, F.sha2("text", 256)).alias("key"), F.transform("hits", entity).alias("entities"), kept.alias("text")))
        total = max(found.count(), 1)
        holders = found.where("key is not null")
        copies = s.write(holders.groupBy("key").agg(F.min("uid").alias("uid"), F.count("*").alias("copies")))
        texts = holders.select("uid", "base", "entities", "text").join(copies.drop("key"), "uid")
        texts = s.write(texts.select("uid", "copies", "base", "entities", tokens(F.col("text")).alias("tokens")))

        owned = texts.select("uid", "copies", F.explode("entities").alias("entity")).groupBy("uid", "copies", "entity").agg(F.count("*").alias("mentions"))
        often = s.write(owned.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts")))
        owned = s.write(owned)
        owned = s.write(C.split_join(owned, often, ["entity"], F.col("texts") * C.HOT_SHARE > owned.count()))
        lone = owned.where("texts = 1").groupBy("uid", "copies", "n_e", (F.col("mentions") >= min_support).alias("sure")).agg(F.min("entity").alias("entity"), F.max("mentions").alias("mentions"))
        cols = ["uid", "entity", "copies", "mentions", "n_e"]
        owned = s.write(owned.where("texts > 1").select(*cols).unionByName(lone.select(*cols)))
        most = owned.groupBy("uid").agg(F.max("n_e").alias("most"))
        # n_te is at most n_e: a term of more documents than these bits allow goes before the pairs
        rare = lambda n, of="n_t": F.col(n) * 2.0**bits_kept >= F.col(of)
        held = s.write(texts.join(most, "uid").select("uid", "copies", "most", F.explode(F.array_distinct("tokens.term")).alias("term")))
        candidates = held.groupBy("term").agg(F.max("most").alias("most"), F.sum("copies").alias("n_h"), F.count("*").alias("texts"))
        candidates = candidates.where(rare("most", "n_h")).drop("n_h")
        words = docs.select(F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))), F.lower)).alias("w")).select(F.explode("w").alias("term"))
        n_t = words.groupBy("term").agg(F.count("*").alias("n_t")).join(candidates, "term")
        n_t = s.write(n_t.where(rare("most")).select("term", "n_t", "texts"))
        held = C.split_join(held, n_t, ["term"], F.col("texts") * C.HOT_SHARE > held.count()).where(rare("most")).select("uid", "term", "n_t")
        pairs = s.write(held.join(owned, "uid").where(rare("n_e")).select("uid", "entity", "term", "n_e", "n_t", "copies", "mentions"))
        flagged = pairs.groupBy("entity", "term").agg(F.sum("mentions").alias("support"), F.sum("copies").alias("n_te"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"), F.count("*").alias("texts"))
        smoothed = (F.col("n_te") + F.col("n_e") / F.lit(float(total))) * 2.0**bits_kept >= F.col("n_t") + 1
        sure = F.col("support") >= min_support
        wholly = F.lit(False) if bits_removed is None else sure & (F.col("n_te") * 2.0**bits_removed >= F.col("n_t"))
        flagged = s.write(flagged.where(F.when(sure, rare("n_te")).otherwise(smoothed)).select("entity", "term", "texts", wholly.alias("wholly")))
        bad = C.split_join(pairs.select("uid", "entity", "term"), flagged, ["entity", "term"], F.col("texts") * C.HOT_SHARE > pairs.count())
        bad = bad.groupBy("uid", "term").agg(F.max("wholly").alias("r"))
        places = texts.select("uid", F.explode("tokens").alias("t")).select("uid", "t.term", "t.s", "t.e").join(bad, ["uid", "term"]).select("uid", "s", "e", "r")
        places = s.write(places)
        taken = texts.join(places.select("uid").distinct(), "uid", "left_semi").select("uid", F.explode("base").alias("x")).select("uid", "x.s", "x.e")
        hits = _uncovered(places, taken).groupBy("uid").agg(F.collect_list(F.struct("s", F.lit(4).alias("k"), "e", "r")).alias("more"))
        hits = s.write(hits.join(copies, "uid").select("key", "more", "copies"))
        more = C.split_join(holders, hits, ["key"], F.col("copies") * C.HOT_SHARE > total, "left").drop("copies")
        none = F.array().cast("array<struct<s:int,k:int,e:int,r:boolean>>")
        out = more.unionByName(found.where("key is null").withColumn("more", none)).withColumn("more", F.coalesce("more", none))
        out = out.withColumn("all", F.array_sort(F.concat(F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.lit(False).alias("r"))), "more")))
        count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
        cols = [F.col("id").alias(id_col), *[count(r).alias(f"n_{k}") for r, k in enumerate(KINDS[:4])], F.size("more").cast("long").alias("n_term"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans")]
        if with_text:
            cols.append(_rewritten().alias("text"))
        return s.write(out.select(*cols), keep=True)


def _rewritten() -> Column:
    """The text with each span replaced; of overlapping spans the first stands for the rest."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def step(a, x):
        first = F.substring("text", x["s"] + 1, F.lit(1))
        term = F.when(first.rlike(r"\p{Lu}"), F.lit("[Name]")).when(first.rlike(r"\p{N}"), F.lit("[number]")).otherwise(F.lit("[word]"))
        mark = F.when(x["r"], F.lit("")).when(x["k"] == 4, term).otherwise(F.element_at(names, x["k"] + 1))
        fresh = F.struct(F.concat(a["out"], F.substring("text", a["at"] + 1, x["s"] - a["at"]), mark).alias("out"), x["e"].alias("at"))
        return F.when(x["s"] >= a["at"], fresh).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], x["e"]).alias("at")))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate("all", start, step, lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.lit(2**31 - 1))))

