"""Personal data: overlapping span candidates judged by boosted trees, in DataFrame functions and Spark ML only."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._shared import give_back, hash_sample

#: The kinds of the base rules in their order, then those that are only proposed.
KINDS = ("email", "ip", "card", "phone", "secret")
#: The base rules, possessive where the next character can't be one of the run, so that no run is read twice; a
#: lookbehind stands for the leftmost start of a run, \G for the end of the match before.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Printable ASCII without quotes, commas and semicolons.
_VALUE = r"[!#-&(-+\x2D-:<-~]"
#: High-recall generators beside the base rules: spelled-out addresses, bracketed dots, dotted or slashed groups of
#: digits, numbers without a country code; for secrets, whatever is assigned (after = or :), and runs of letters and digits
#: of 20 to 256 characters. They propose, the trees decide.
PROPOSED = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|@| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]{1,63}+){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)| \. )[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}+(?:[./_][0-9]{4}+){3}(?:[./_][0-9]{1,3}+)?(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}+\)?[ ./-]{1,2}+[0-9]{2,4}+[ ./-][0-9]{2,4}+(?:[ ./-][0-9]{2,4}+)?(?![0-9A-Za-z])",
    "secret": rf"""(?:(?<=[:=])|(?<=[:=] )|(?<=[:=]["'])|(?<=[:=] ["'])){_VALUE}{{6,256}}+(?!{_VALUE})|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{20,256}}+={{0,2}}+(?![A-Za-z0-9+/_=-])""",
}
_HINTS = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|courriel|correo)\W*\w*\W*$",
    "ip": r"(?i)(?:\bip|host|server|addr\w*|from|login)\W*\w*\W*$",
    "card": r"(?i)(?:card|visa|master\w*|amex|pay\w*|karte|carte|tarjeta)\W*\w*\W*$",
    "phone": r"(?i)(?:phone|tel\w*|call|fax|mobile|cell|ring|handy)\W*\w*\W*$",
    "secret": r"(?i)(?:token|secret|passw\w*|passphrase|pwd|key|credential\w*|auth\w*|bearer)\W*(?:id|is|value)?\W*$",
}
_AGAINST = r"(?i)(?:order|invoice|version|\bver|\bv|isbn|ref|\bid|date|section|chapter|page|build|part|no|commit|sha-?[0-9]*|md5|checksum|digest|hash|etag|rev\w*)\W*$"
_DATE = r"^(?:(?:19|20)[0-9]{2}[ ./-][0-9]{1,2}[ ./-][0-9]{1,2}|[0-9]{1,2}[ ./-][0-9]{1,2}[ ./-](?:19|20)[0-9]{2})$"
_ASSIGNED = r"[:=] ?[\x22']?$"
#: Candidates to learn from, share of them that calibrates, precision that a threshold must reach, trees, depth.
TRAIN, CALIBRATE, PRECISION, TREES, DEPTH = 6000, 4, 0.95, 10, 4
#: Documents, about, of which each lends a candidate to learn from what stands around it.
CONTEXTS = 1000
BEFORE, AFTER = 24, 8
#: Matches whose places are summed up at a time.
RUN = 128


def _let(value: Column, use) -> Column:
    """use(value), with value computed once, also where use has lambdas of its own."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of a pattern's matches: code points, end exclusive.

    Places are summed up in runs of RUN matches and then over the runs, as appending to one array of all would take time
    in the square of the matches.
    """
    lone = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(F.split(text, pattern, -1), lone, lambda gap, m: F.struct(F.char_length(gap).alias("gap"), m.alias("m")))
    kind = "array<struct<s:int,e:int,m:string>>"
    none = F.expr(f"cast(array() as {kind})")
    span = lambda s, e, m: F.array(F.struct(s.alias("s"), e.alias("e"), m.alias("m")))

    def step(acc: Column, p: Column) -> Column:
        start = acc.at + p.gap
        end = start + F.char_length(p.m)
        return F.when(p.m.isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc.out, span(start, end, p.m)).alias("out")))

    def placed(acc: Column, run: Column) -> Column:
        moved = F.transform(run.out, lambda x: F.struct((x.s + acc.at).alias("s"), (x.e + acc.at).alias("e"), x.m.alias("m")))
        return F.struct((acc.at + run.at).alias("at"), F.concat(acc.out, F.array(moved)).alias("out"))

    def found(every: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(every), F.lit(1)), F.lit(RUN))
        runs = F.transform(starts, lambda i: F.aggregate(F.slice(every, i, F.lit(RUN)), F.struct(F.lit(0).alias("at"), none.alias("out")), step))
        return F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out")), placed, lambda acc: F.flatten(acc.out))

    return F.when(F.regexp_like(text, F.lit(pattern)), _let(pieces, found)).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), step) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<kind, s, e>> of the base rules, kind by its place in KINDS; failing matches are dropped."""
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    keep = {
        "ip": lambda x: F.regexp_like(x.m, F.lit(rf"^{octet}(?:\.{octet}){{3}}$")),
        "card": lambda x: F.char_length(x.d).between(12, 19) & luhn(x.d),
        "phone": lambda x: F.char_length(x.d).between(9, 15),
    }
    parts = []
    for k, kind in enumerate(BASE):
        found = matches(text, BASE[kind])
        if kind in ("card", "phone"):
            found = F.transform(found, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), _digits(x.m).alias("d")))
        if kind in keep:
            found = F.filter(found, keep[kind])
        parts.append(F.transform(found, lambda x: F.struct(F.lit(k).alias("kind"), x.s.alias("s"), x.e.alias("e"))))
    return F.concat(*parts)


def proposals(text: Column) -> Column:
    """array<struct<kind, s, e>> of the generators, overlaps included."""
    return F.concat(*[F.transform(matches(text, PROPOSED[kind]), lambda x: F.struct(F.lit(k).alias("kind"), x.s.alias("s"), x.e.alias("e"))) for k, kind in enumerate(KINDS)])


def features(c: Column) -> dict[str, Column]:
    """Format and context of a candidate c(kind, m, before, after), as numbers."""
    count = lambda pattern: F.regexp_count(c.m, F.lit(pattern)).cast("double")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    hint = F.lit(False)
    for k, kind in enumerate(KINDS):
        hint = F.when(c.kind == k, F.regexp_like(c.before, F.lit(_HINTS[kind]))).otherwise(hint)
    return {
        "kind": c.kind.cast("double"),
        "digits": count("[0-9]"),
        "groups": count("[0-9]++"),
        "letters": count("[A-Za-z]"),
        "length": F.char_length(c.m).cast("double"),
        "marks": count(r"[@()\[\]]"),
        "at_word": flag(F.contains(c.m, F.lit(" at "))),
        "dot_word": flag(F.regexp_like(c.m, F.lit(r"\(dot\)|\[dot\]| dot "))),
        "bracket": flag(F.startswith(c.m, F.lit("("))),
        "top_level": flag(F.regexp_like(c.m, F.lit(r"[A-Za-z]{2,6}$"))),
        "octets": flag(F.regexp_like(c.m, F.lit(r"^(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\D+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"))),
        "date": flag(F.regexp_like(c.m, F.lit(_DATE))),
        "luhn": flag(luhn(F.concat(F.lit("0"), _digits(c.m)))),
        "hint": flag(hint),
        "against": flag(F.regexp_like(c.before, F.lit(_AGAINST))),
        "assigned": flag(F.regexp_like(c.before, F.lit(_ASSIGNED))),
        "hex": flag(F.regexp_like(c.m, F.lit("^[0-9A-Fa-f]{16,}$"))),
        "classes": sum(flag(F.regexp_like(c.m, F.lit(x))) for x in ("[a-z]", "[A-Z]", "[0-9]", r"[!#-&*+=?@^~]")),
        "distinct": F.size(F.array_distinct(F.split(c.m, ""))).cast("double"),
        "touches": flag(F.regexp_like(c.after, F.lit(r"^[A-Za-z0-9%$€]"))),
    }


def _pick(h: Column, salt: int, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(h, F.lit(salt)), F.lit(len(values))) + 1).cast("int"))


def _number(h: Column, salt: int, low: int, high: int) -> Column:
    return (F.lit(low) + F.pmod(F.xxhash64(h, F.lit(salt)), F.lit(high - low + 1))).cast("string")


def contexts(docs: DataFrame, n: int = CONTEXTS) -> DataFrame:
    """One row, around: array<struct<left, right>>, the words before and after a place in each of n documents (2 * n at most)."""
    texts = hash_sample(docs.select(F.col("text").cast("string").alias("text")).where(r"text rlike '\\s'"), "text", n)
    at = F.pmod(F.xxhash64("text", F.lit(5)), F.greatest(F.char_length("text") - 40, F.lit(1))).cast("int")
    window = texts.select(F.substr("text", at + 1, F.lit(32)).alias("left"), F.substr("text", at + 33, F.lit(AFTER)).alias("right"))
    pair = F.struct(F.regexp_extract("left", r"(?s)^(.*)\s", 1).alias("left"), F.regexp_replace("right", r"^\S*\s*", "").alias("right"))
    return window.agg(F.array_sort(F.collect_set(pair)).alias("around"))  # short strings of a bounded sample


def examples(spark: SparkSession, n: int = TRAIN, docs: DataFrame | None = None) -> DataFrame:
    """kind, m, before, after, label: n candidates, personal data and look-alikes drawn from templates.

    Given docs, they stand where contexts() found places, between the words of the corpus.
    """
    h = F.col("id")
    num = lambda salt, low, high: _number(h, salt, low, high)
    quad = lambda salt, sep: F.call_function("concat_ws", F.lit(sep), *[F.lpad(num(salt + i, 0, 9999), 4, "0") for i in range(4)])
    name, host, top = _pick(h, 1, ["ann", "j.doe", "info", "max_m", "sales", "li99"]), _pick(h, 2, ["example", "mail5", "acme", "uni-x"]), _pick(h, 3, ["com", "org", "de", "net", "fr"])
    sep = _pick(h, 4, ["-", " ", ".", "/"])
    digits = F.col("digits")
    check = F.pmod(10 - F.aggregate(F.sequence(F.lit(0), F.lit(14)), F.lit(0), lambda t, i: t + F.when(i % 2 == 1, F.substr(digits, 15 - i, F.lit(1)).cast("int")).when(F.substr(digits, 15 - i, F.lit(1)).cast("int") > 4, 2 * F.substr(digits, 15 - i, F.lit(1)).cast("int") - 9).otherwise(2 * F.substr(digits, 15 - i, F.lit(1)).cast("int"))) % 10, F.lit(10))
    valid = F.concat(F.substr(digits, F.lit(1), F.lit(15)), check.cast("string"))
    dotted = _pick(h, 5, [".", "/", "_"])
    card = F.call_function("concat_ws", dotted, *[F.substr("valid", F.lit(1 + 4 * i), F.lit(4)) for i in range(4)])
    mark = _pick(h, 6, ["[.]", "(.)"])
    # (kind, positive, text, words before it)
    hints = {0: ["e-mail: ", "contact me at ", "mail ", ""], 1: ["host ", "ip address ", "login from ", ""], 2: ["card ", "visa no. ", "paid by card ", ""], 3: ["phone: ", "call ", "tel. ", "fax "], 4: ['token = "', "api_key=", "password: ", "SECRET='", "client_secret: ", 'access key: "', "Authorization: Bearer ", "pwd="]}
    plain = ["the ", "of ", "and then ", "value "]
    against = ["order ", "version ", "ref ", "section ", "date ", "id "]
    code = F.sha1(h.cast("string"))
    mixed = F.base64(F.unhex(F.substr(code, F.lit(1), F.lit(36))))
    word = _pick(h, 13, ["required", "string", "changed", "unknown", "something", "another", "enabled", "documents"])
    named = ["title: ", "note: ", "lang=", "see: ", "size = ", 'name="']
    sums = ["commit ", "sha1: ", "md5=", "checksum ", 'etag: "', "hash = ", "revision "]
    forms = [
        (0, 1, F.concat(name, _pick(h, 7, [" (at) ", "[at]", " [at] ", "(at)"]), host, _pick(h, 8, [" (dot) ", "[dot]", "."]), top), hints[0]),
        (0, 1, F.concat(name, F.lit(" at "), host, F.lit(" dot "), top), hints[0]),
        (0, 0, F.concat(_pick(h, 9, ["look", "meet", "arrive", "we"]), F.lit(" at "), _pick(h, 10, ["noon", "home", "it", "dawn"]), _pick(h, 12, [". ", "."]), _pick(h, 11, ["Then", "So", "He", "Another"])), plain),
        (1, 1, F.call_function("concat_ws", mark, num(30, 1, 255), num(31, 0, 255), num(32, 0, 255), num(33, 1, 254)), hints[1]),
        (1, 0, F.concat_ws(" . ", num(34, 1, 999), num(35, 256, 999), num(36, 0, 999), num(37, 0, 999)), plain + against),
        (2, 1, card, hints[2]),
        (2, 0, F.call_function("concat_ws", dotted, *[F.lpad(num(40 + i, 0, 9999), 4, "0") for i in range(4)]), plain + against),
        (3, 1, F.concat(F.lit("("), num(50, 201, 989), F.lit(") "), num(51, 200, 999), F.lit("-"), F.lpad(num(52, 0, 9999), 4, "0")), hints[3] + plain),
        (3, 1, F.call_function("concat_ws", sep, num(53, 201, 989), num(54, 200, 999), F.lpad(num(55, 0, 9999), 4, "0")), hints[3]),
        (3, 0, F.call_function("concat_ws", sep, num(56, 1990, 2030), F.lpad(num(57, 1, 12), 2, "0"), F.lpad(num(58, 1, 28), 2, "0")), plain + against),
        (3, 0, F.call_function("concat_ws", sep, num(59, 10, 99), num(60, 10, 999), num(61, 10, 999)), plain + against),
        (3, 0, F.call_function("concat_ws", sep, num(62, 201, 989), num(63, 200, 999), F.lpad(num(64, 0, 9999), 4, "0")), against),
        (4, 1, code, hints[4]),
        (4, 1, F.upper(F.substr(code, F.lit(1), F.lit(32))), hints[4]),
        (4, 1, mixed, hints[4]),
        (4, 1, F.concat(_pick(h, 14, ["sk_live_", "ghp_", "AKIA", "xoxb-"]), F.substr(F.regexp_replace(mixed, "[^A-Za-z0-9]", "x"), F.lit(1), F.lit(20))), hints[4] + plain),
        (4, 1, F.concat(F.initcap(word), num(15, 1, 9999), _pick(h, 16, ["!", "#", "$", "?", ""])), hints[4]),
        (4, 0, word, hints[4] + named),
        (4, 0, code, sums),
        (4, 0, F.concat(quad(41, ""), num(42, 0, 9999)), plain + against + named),
        (4, 0, F.concat(F.lit("//"), host, F.lit("."), top, F.lit("/"), word, num(43, 1, 99)), ["http:", "see https:"]),
        (4, 0, F.concat(num(44, 10, 59), F.lit(":"), num(45, 10, 59), F.lit("."), num(46, 100, 999)), ["at 12:", "time=09:"]),
        (4, 0, F.concat(word, F.lit("-"), _pick(h, 17, ["chapter", "section", "version", "module"]), F.lit("/"), word, num(47, 1, 99)), plain + named),
        (4, 0, F.concat(word, word, word, num(48, 1, 9)), plain),
    ]
    which = F.pmod(F.xxhash64(h, F.lit(99)), F.lit(len(forms)))
    made = [F.struct(F.lit(k).alias("kind"), text.alias("m"), _pick(h, 70 + i, words).alias("before"), F.lit(y).alias("label")) for i, (k, y, text, words) in enumerate(forms)]
    closing = F.when(F.col("before").rlike("[\\x22']$"), F.substr("before", F.lit(-1))).otherwise("")
    # columns of their own, as each place that reads them would hold them whole in the plan otherwise
    rows = spark.range(n, numPartitions=2).withColumn("digits", quad(20, "")).withColumn("valid", valid)
    rows = rows.select(F.element_at(F.array(*made), (which + 1).cast("int")).alias("c"), "id").select("c.*", "id")
    rows = rows.withColumn("after", F.concat(closing, _pick(h, 98, [" ", ".", ",", " and", "%"])))
    if docs is None:
        return rows
    place = F.get("around", F.pmod(F.xxhash64("id", F.lit(97)), F.greatest(F.size("around"), F.lit(1))).cast("int"))
    rows = rows.crossJoin(F.broadcast(contexts(docs))).withColumn("place", place)  # of one row
    left, right = (F.coalesce(F.col(f"place.{side}"), F.lit("")) for side in ("left", "right"))
    # a word that says nothing gives way to the words of the corpus
    own = F.when(F.col("before").isin(plain), F.lit("")).otherwise(F.col("before"))
    before, after = F.concat(left, F.lit(" "), own), F.concat("after", F.lit(" "), right)
    return rows.select("kind", "m", F.right(before, F.lit(BEFORE)).alias("before"), F.left(after, F.lit(AFTER)).alias("after"), "label", "id")


@dataclass
class Judge:
    """Boosted trees as a SQL expression of features, and the least score of each kind."""

    trees: list[tuple[float, object]]
    least: list[float]
    names: list[str]

    def score(self, f: dict[str, Column]) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, limit, low, high = node
            return F.when(f[self.names[feature]] <= limit, walk(low)).otherwise(walk(high))

        total = F.lit(0.0)
        for weight, tree in self.trees:
            total = total + weight * walk(tree)
        return 1 / (1 + F.exp(-2 * total))


def _tree(lines: list[str]) -> object:
    """A tree from Spark's printed form: nested If/Else lines over features."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return float(line.split(":")[1])
    feature, limit = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line).groups()
    low = _tree(lines)
    lines.pop(0)  # its Else
    return (int(feature), float(limit), low, _tree(lines))


def train(spark: SparkSession, docs: DataFrame | None = None, n: int = TRAIN) -> Judge:
    """Fit the trees on three quarters of n examples(), and on the rest the least score of PRECISION for each kind.

    docs(text), if given, lend the contexts of the examples, from a sample of bounded size.
    """
    give_back(spark)
    rows = examples(spark, n, docs)
    f = features(F.struct("kind", "m", "before", "after"))
    rows = rows.select("id", "label", *[c.alias(k) for k, c in f.items()])
    rows = VectorAssembler(inputCols=[*f], outputCol="x").transform(rows).persist()
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=3).fit(rows.where(f"id % {CALIBRATE} <> 0"))
    trees = [(w, _tree([x for x in t.toDebugString.splitlines()[1:] if x.strip()])) for w, t in zip(model.treeWeights, model.trees, strict=True)]
    judge = Judge(trees, [], [*f])
    held = rows.where(f"id % {CALIBRATE} = 0").select(F.col("kind").cast("int").alias("kind"), F.round(judge.score({k: F.col(k) for k in f}), 6).alias("p"), "label")
    steps = held.groupBy("kind", "p").agg(F.sum("label").alias("yes"), F.count("*").alias("all")).orderBy("kind", F.desc("p")).collect()
    rows.unpersist()
    give_back(spark)
    for k in range(len(KINDS)):
        yes = every = 0
        least = 2.0  # no score reaches it
        for r in (r for r in steps if r.kind == k):
            yes, every = yes + r.yes, every + r["all"]
            if yes >= PRECISION * every:
                least = max(0.5, r.p - 1e-6)
        judge.least.append(least)
    return judge


def find(docs: DataFrame, judge: Judge, prefix: str = "pii") -> DataFrame:
    """docs with pii_base and pii_spans (or another prefix), arrays of (kind, s, e) by start, then kind: code points, end exclusive.

    pii_base holds what the base rules find, pii_spans also the proposed candidates that the trees accept
    and that touch no base span; where accepted ones overlap, the leftmost longest stays. Null and
    empty texts have no spans. Columns of these names are replaced, others pass through; repeated rows stay.
    Everything is computed within the row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base, spans = f"{prefix}_base", f"{prefix}_spans"
    docs = docs.drop(base, spans)

    packed = lambda x: x.kind.cast("long") * (1 << 60) + x.s.cast("long") * (1 << 30) + x.e

    def context(c: Column) -> Column:
        """Of a packed candidate, its span, its text and what stands around it."""
        kind, s, e = (F.pmod(F.shiftright(c, n), F.lit(1 << 30)).cast("int") for n in (60, 30, 0))
        start = F.greatest(s - BEFORE, F.lit(0))
        return F.struct(kind.alias("kind"), s.alias("s"), e.alias("e"), F.substr(text, s + 1, e - s).alias("m"), F.substr(text, start + 1, s - start).alias("before"), F.substr(text, e + 1, F.lit(AFTER)).alias("after"))

    least = F.array(*map(F.lit, judge.least))
    found = docs.withColumn(base, _sorted(base_spans(text)))
    # what the base rules have found needs no judgement; numbers, as Spark hashes these
    left = F.array_except(F.transform(proposals(text), packed), F.transform(base, packed))
    accepted = F.filter(F.transform(left, context), lambda c: judge.score(features(c)) >= F.element_at(least, c.kind + 1))
    bare = F.transform(accepted, lambda c: F.struct(c.kind.alias("kind"), c.s.alias("s"), c.e.alias("e")))
    found = found.withColumn(spans, bare)
    apart = F.filter(spans, lambda c: ~F.exists(base, lambda b: (b.s < c.e) & (c.s < b.e)))
    first = F.aggregate(_sorted(apart), F.expr("cast(array() as array<struct<kind:int,s:int,e:int>>)"), lambda out, c: F.when((F.size(out) == 0) | (F.element_at(out, -1).e <= c.s), F.concat(out, F.array(c))).otherwise(out))
    return found.withColumn(spans, F.when(F.size(spans) == 0, F.col(base)).otherwise(_sorted(F.concat(F.col(base), first))))


def _sorted(spans: Column) -> Column:
    """By start, kind; then the longer one."""
    keyed = F.transform(spans, lambda x: F.struct(x.s.alias("s"), x.kind.alias("kind"), (-x.e).alias("e")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x.kind.alias("kind"), x.s.alias("s"), (-x.e).alias("e")))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x.kind + 1), x.s.cast("string"), x.e.cast("string"))), ",")


def redact(docs: DataFrame, judge: Judge) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets; null texts stay null, other columns as they are."""
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    prefix = f"pii_{uuid.uuid4().hex}"  # no column of docs has such a name
    found = find(docs, judge, prefix)

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(F.col("text"), acc.at + 1, x.s - acc.at)
        put = F.struct(x.e.alias("at"), F.concat(acc.out, F.array(gap, F.element_at(kinds, x.kind + 1))).alias("out"))
        return F.when(x.s >= acc.at, put).otherwise(F.struct(F.greatest(acc.at, x.e).alias("at"), acc.out.alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    done = F.aggregate(f"{prefix}_spans", start, step, lambda acc: F.concat(F.array_join(acc.out, ""), F.substr(F.col("text"), acc.at + 1, F.char_length("text") - acc.at)))
    return found.withColumn("text", F.when(F.size(f"{prefix}_spans") > 0, done).otherwise(F.col("text"))).select(*docs.columns)
