"""Personal data by candidate gradient boosting.

Base patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers by rule. High-recall generators
propose more, overlapping spans, also of forms that no base pattern matches and of secrets; boosted trees judge each by
its format and context, and a span is added where its score reaches a threshold calibrated on held-out candidates. The
trees are trained by Spark ML and then written out as one column expression, so that scoring is a projection like the
patterns: no shuffle, and nothing but built-ins.

Training examples come from all texts. Labels come from what is planted, not from a rule on form:
rewritten copies, in which each base match takes a form that the base patterns miss and secrets lose what gave them away,
give positives; so do numbers and secrets put into windows of the texts after words that tell what they are. The same
forms put after other words (order numbers that pass the card check, part numbers in phone form, checksums, products of
matrices) give negatives, as does a form that is common among clean text without such a word. What already stands in the
texts, is unknown and looks right has no label; what is unknown and looks wrong is negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, n_partitions, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
# Fixed by the contract; possessive loops keep Java's matcher from recursing, and an address is only begun where a run of its
# characters or the search begins, which keeps long runs linear; they match the same.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
ALL_KINDS = (*KINDS, "secret")
_AT, _DOT = r"\x20?(?:@|[(\[]at[)\]])\x20?", r"\x20?(?:\.|[(\[]dot[)\]])\x20?"
#: Generators: what might be personal data or a secret, in a wider form.
WIDE = {
    "email": rf"[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": r"[0-9]{1,5}(?:\x20?(?:[.,:]|\[\.\]|[(\[]dot[)\]])\x20?[0-9]{1,5}){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){11,18}(?![0-9])",
    "phone": r"[+(]?[0-9][\x20()./0-9-]{5,20}[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{16,}+",
}
WIDE_NEEDS = {
    "email": r"@|[(\[]at[)\]]",
    "ip": r"[0-9]\x20?(?:[.,:]|\[\.\]|[(\[]dot[)\]])\x20?[0-9]",
    "card": r"[0-9](?:[\x20./-]?[0-9]){11}",
    "phone": r"[0-9][\x20()./0-9-]{5}",
    "secret": r"[A-Za-z0-9_-]{16}",
}
#: What a secret is known by when examples are labelled: a name, an assignment sign, maybe a quote.
NAMED = r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|credential)s?\x20?[=:]\x20?[\x22']?"
#: Copies: each base form in one that its pattern misses; secrets without their names.
REWRITE = (
    (r"([A-Za-z0-9._%+-]++)@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)\.([A-Za-z0-9-]+)", "$1 (at) $2 (dot) $3"),
    (r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)", "$1[.]$2[.]$3[.]$4"),
    (r"(?<![0-9])([0-9]{4})[\x20-]?([0-9]{4})[\x20-]?([0-9]{4})[\x20-]?([0-9]{1,7})(?![0-9])", "$1.$2.$3.$4"),
    (r"\+([0-9][\x20().0-9-]+[0-9])", "$1"),
    (NAMED + r"([A-Za-z0-9_-]{16,})", "value $1"),
)
#: Words before a candidate that tell its kind, or that it is something else.
CUES = {
    "email": r"mail|contact|write|reach|send",
    "ip": r"host|ip|addr(?:ess)?|server|login|from|client|visitor",
    "card": r"card|visa|mastercard|amex|credit|debit|paid|pay|charged?|billed",
    "phone": r"call|phone|tel|telephone|mobile|cell|fax|dial|text|whatsapp|reach",
    "secret": r"token|secret|passw(?:or)?d|api[\x20_-]?key|access[\x20_-]?key|credentials?|bearer|auth",
}
OTHER_CUES = r"order|invoice|parts?|item|sku|serial|tracking|ticket|ref|isbn|model|parcel|version|release|firmware|build|ratio|times?|scores?|commit|sha[0-9]*|md5|hash|digest|checksum|uuid|revision|blob|price|qty|tensor|matrix"
#: Plants: (kind, words before, forms, whether it is one). Forms are those of ``made``.
PLANTS = (
    ("email", ("mail", "contact", "write to", "e-mail:", "", ""), ("spelt_mail", "wide_mail"), True),
    ("email", ("price", "qty", "tensor", "", "matrix"), ("product", "count_at_price"), False),
    ("ip", ("from host", "login from", "client ip", "server", "", ""), ("bracket_ip", "spelt_ip"), True),
    ("ip", ("visitor ip", "address:", "host"), ("comma_ip", "colon_ip"), True),
    ("ip", ("version", "release", "firmware", "build"), ("bracket_ip", "spaced_ip"), False),
    ("ip", ("ratio", "times", "scores", "", ""), ("comma_ip", "colon_ip"), False),
    ("card", ("card", "paid by visa", "credit card number", "charged to", "", ""), ("dot_card", "slash_card"), True),
    ("card", ("order", "invoice", "tracking", "serial", "parcel"), ("dot_card", "slash_card", "slip_card"), False),
    ("card", ("", "", "ref", "item"), ("slip_card",), False),
    ("phone", ("call", "phone:", "mobile", "tel", "fax", "", ""), ("paren_phone", "dash_phone", "trunk_phone"), True),
    ("phone", ("call", "phone", "dial", "text"), ("plain_phone", "pair_phone"), True),
    ("phone", ("part", "item", "sku", "order", "ticket", "model"), ("paren_phone", "dash_phone", "plain_phone", "pair_phone"), False),
    ("phone", ("", "", "ref"), ("plain_phone", "pair_phone", "long_digits"), False),
    ("secret", ("password", "api key", "token", "bearer", "value", ""), ("hex32", "hex40", "hex64"), True),
    ("secret", ("password:", "secret", "token", "credentials"), ("mixed", "uuid"), True),
    ("secret", ("commit", "sha256", "md5", "checksum", "revision", "blob"), ("hex32", "hex40", "hex64"), False),
    ("secret", ("", "uuid", "build", "release"), ("mixed", "uuid"), False),
)
AROUND = 60  # code points of a text on each side of a plant
MIN_PRECISION = 0.98
CONTEXT = 24
_SPANS = "array<struct<start:int,no:int,end:int>>"
_CELL = "array<struct<start:int,end:int,txt:string>>"


def found(text: Column, pattern: str, needs: str) -> Column:
    """array<struct<start, end, txt>> of a pattern's matches, leftmost and non-overlapping, in code points."""

    def lay(s: Column) -> Column:
        start = lambda a, i: a.at + F.length(F.get(s.gaps, i))

        def step(a: Column, i: Column) -> Column:
            end = start(a, i) + F.length(F.get(s.hits, i))
            return F.struct(end.alias("at"), F.concat(a.out, F.array(F.struct(start(a, i).alias("start"), end.alias("end"), F.get(s.hits, i).alias("txt")))).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(_CELL).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(s.hits) - 1), zero, step, lambda a: a.out)

    def both(h: Column) -> Column:
        return F.when(F.size(h) > 0, _let(F.struct(h.alias("hits"), F.split(text, pattern, -1).alias("gaps")), lay)).otherwise(F.array().cast(_CELL))

    return F.when(text.rlike(needs), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), both)).otherwise(F.array().cast(_CELL))


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def digits_of(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(t: Column) -> Column:
    def total(d: Column) -> Column:
        def term(a: Column, i: Column) -> Column:
            x = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int")
            twice = x * 2 - F.when(x > 4, 9).otherwise(0)
            return a + F.when(i % 2 == 0, twice).otherwise(x)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), term) % 10 == 0

    return _let(digits_of(t), lambda d: F.when(F.length(d).between(12, 19), total(d)).otherwise(False))


def octets(t: Column) -> Column:
    return F.forall(F.split(t, r"\."), lambda p: _let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 3) & (F.concat(F.lit("0"), F.substr(q, F.lit(1), F.lit(3))).cast("int") <= 255)))


VALID = {
    "email": lambda t: F.lit(True),
    "ip": octets,
    "card": luhn,
    "phone": lambda t: F.length(digits_of(t)).between(9, 15),
}


def base_spans(text: Column) -> Column:
    """array<struct<start, no, end>> of the base patterns' matches that pass their rule, by start, then kind."""

    def kind(i: int, k: str) -> Column:
        good = F.filter(found(text, BASE[k], NEEDS[k]), lambda s: VALID[k](s.txt))
        return F.transform(good, lambda s: F.struct(s.start.alias("start"), F.lit(i).alias("no"), s.end.alias("end"))).cast(_SPANS)

    return F.array_sort(F.concat(*[kind(i, k) for i, k in enumerate(KINDS)]))


FEATURES = ("length", "digits", "letters", "blanks", "dots", "dashes", "plus", "at", "parens", "words_at", "distinct", "runs", "luhn", "octets", "prior_digit", "prior_letter", "next_digit", "next_letter", "prior_sign", "prior_words_digits", "line_start", "own_cue", "other_cue", *ALL_KINDS)


def undone(kind: str, t: Column) -> Column:
    """A candidate in the form that the base patterns know: '(at)', '(dot)', '[.]' and other separators taken back."""
    if kind == "email":
        t = F.regexp_replace(F.regexp_replace(t, r"\x20?[(\[]at[)\]]\x20?|\x20?@\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?|\x20?\.\x20?", ".")
    elif kind == "ip":
        t = F.regexp_replace(t, r"\x20?(?:[.,:]|\[\.\]|[(\[]dot[)\]])\x20?", ".")
    elif kind in ("card", "phone"):
        t = digits_of(t)
    return t


def plausible(kind: str, t: Column) -> Column:
    """Whether a candidate passes its kind's rule once undone; plain runs of digits are no phone number."""
    u = undone(kind, t)
    if kind == "email":
        return u.rlike("^" + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}" + "$")
    if kind == "ip":
        return octets(u) & t.rlike(r"\[\.\]|dot|^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")
    if kind == "card":
        return luhn(u)
    if kind == "phone":
        return F.length(u).between(9, 15) & t.rlike(r"^\+?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}$")
    return t.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:sk|pk)_(?:test|live)_[A-Za-z0-9]+|AKIA[0-9A-Z]{16})$")  # random-looking


def _cue(words: str) -> str:
    """A pattern for the last two words or so before a candidate, at least one of ``words``."""
    return rf"(?i)(?<![A-Za-z])(?:{words})(?![A-Za-z])[^\n]{{0,12}}$"


def proposed(text: Column, kind: str) -> Column:
    return found(text, WIDE[kind], WIDE_NEEDS[kind])


def candidates(text: Column) -> Column:
    """array of proposed spans (start, no, end, txt) with their features (doubles)."""

    def count(t: Column, chars: str) -> Column:
        return (F.length(t) - F.length(F.regexp_replace(t, chars, ""))).cast("double")

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("double")

    def of(i: int, k: str) -> Column:
        def row(s: Column) -> Column:
            prior = F.substr(text, F.greatest(F.lit(1), s.start + 1 - CONTEXT), F.least(F.lit(CONTEXT), s.start))
            after = F.substr(text, s.end + 1, F.lit(1))
            t = s.txt
            values = [
                F.length(t).cast("double"), count(t, "[0-9]"), count(t, "[A-Za-z]"), count(t, r"\x20"), count(t, r"\."), count(t, "-"), count(t, r"\+"), count(t, "@"), count(t, "[()\\[\\]]"), flag(t.rlike(r"[(\[](?:at|dot)[)\]]|\[\.\]")),
                F.size(F.array_distinct(F.split(F.lower(t), ""))).cast("double"), F.size(F.split(t, "[0-9]+")).cast("double"),
                flag(luhn(t)), flag(octets(undone("ip", t)) if k == "ip" else F.lit(False)), flag(prior.rlike("[0-9]$")), flag(prior.rlike(r"\p{L}$")), flag(after.rlike("^[0-9]")), flag(after.rlike(r"^\p{L}")),
                flag(prior.rlike(r"[=:\x22'][\x20\x22']*$")), count(prior, "[0-9]"), flag((prior == "") | prior.endswith("\n")),
                flag(prior.rlike(_cue(CUES[k]))), flag(prior.rlike(_cue(OTHER_CUES))), *[F.lit(float(j == i)) for j in range(len(ALL_KINDS))],
            ]
            return F.struct(s.start.alias("start"), F.lit(i).alias("no"), s.end.alias("end"), t.alias("txt"), *[v.alias(f) for v, f in zip(values, FEATURES, strict=True)])

        kind = ",".join(f"{f}:double" for f in FEATURES)
        return F.transform(proposed(text, k), row).cast(f"array<struct<start:int,no:int,end:int,txt:string,{kind}>>")

    return F.concat(*[of(i, k) for i, k in enumerate(ALL_KINDS)])


def tree_column(model, value) -> Column:
    """A fitted gradient-boosted model's probability as an expression; value(i) is the i-th feature."""

    def node(x) -> Column:
        if x.getClass().getSimpleName() == "LeafNode":
            return F.lit(float(x.prediction()))
        s = x.split()
        return F.when(value(s.featureIndex()) <= float(s.threshold()), node(x.leftChild())).otherwise(node(x.rightChild()))

    total = F.lit(0.0)
    for tree, weight in zip(model._java_obj.trees(), model.treeWeights, strict=True):
        total = total + node(tree.rootNode()) * float(weight)
    return 1.0 / (1.0 + F.exp(-2.0 * total))


def examples(docs: DataFrame) -> DataFrame:
    """(doc_id, label, addable and the columns of a candidate) from texts and their rewritten copies.

    A candidate is positive if, its writing undone, it is a base match or named secret of the text; of the others, those
    that fail their kind's rule and stand after no word for it are negative; the rest have no label.

    Candidates that overlap a base match without being one are left out: they can't be added, nor are they wrong.
    """
    text = F.col("text")

    def base_forms(i: int, k: str) -> Column:
        good = F.filter(found(text, BASE[k], NEEDS[k]), lambda s: VALID[k](s.txt))
        return F.transform(good, lambda s: F.concat(F.lit(f"{i}:"), undone(k, s.txt)))

    named = F.regexp_extract_all(text, F.lit(NAMED + r"([A-Za-z0-9_-]{16,})"), F.lit(1))
    secrets = F.transform(named, lambda x: F.concat(F.lit(f"{len(KINDS)}:"), x))
    known = F.concat(*[base_forms(i, k) for i, k in enumerate(KINDS)], secrets)
    copy = F.col("text")
    for pattern, put in REWRITE:
        copy = F.regexp_replace(copy, pattern, put)
    rows = docs.withColumn("known", known).withColumn("t", F.explode(F.array("text", copy)))
    rows = rows.select("doc_id", "known", base_spans(F.col("t")).alias("base"), F.explode(candidates(F.col("t"))).alias("c"))
    c = F.col("c")
    form, rule = F.lit(None).cast("string"), F.lit(False)
    for i, k in enumerate(ALL_KINDS):
        form, rule = F.when(c.no == i, undone(k, c.txt)).otherwise(form), F.when(c.no == i, plausible(k, c.txt)).otherwise(rule)
    looks = F.coalesce(rule, F.lit(False))
    label = F.when(F.array_contains("known", F.concat(c.no.cast("string"), F.lit(":"), form)), 1.0).when(~looks & (c.own_cue == 0), 0.0)
    same = F.exists("base", lambda b: (b.start == c.start) & (b.end == c.end) & (b.no == c.no))
    near = F.exists("base", lambda b: (b.start < c.end) & (c.start < b.end))
    d = rows.select("doc_id", label.alias("label"), (~near).alias("addable"), same.alias("same"), "c.*")
    return d.where("label is not null and (addable or same)").drop("same", "txt")


def made(form: str, seed: Column) -> Column:
    """A value of a form, its digits and letters drawn by ``seed``, a string."""

    def draw(salt: int) -> Column:
        return F.sha2(F.concat(seed, F.lit(f"/{form}/{salt}")), 512)

    def number(n: int, salt: int = 0) -> Column:
        return F.substr(F.concat(digits_of(draw(salt)), F.lit("31" * n)), F.lit(1), F.lit(n))

    def octet(i: int) -> Column:
        return (F.conv(F.substr(draw(9), F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("int")).cast("string")

    def card(shift: int) -> Column:
        def closed(d: Column) -> Column:  # 15 digits: the first and every second one after it count twice
            def term(a: Column, i: Column) -> Column:
                x = F.substr(d, i, F.lit(1)).cast("int")
                return a + F.when(i % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)

            total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), term)
            return F.concat(d, ((100000 - total + shift) % 10).cast("string"))

        return _let(F.concat(F.lit("4"), number(14)), closed)

    def word(i: int, n: int = 6) -> Column:
        return F.translate(F.substr(draw(i), F.lit(1), F.lit(n)), "0123456789", "klmnoprstu")

    def cut(t: Column, shape: str) -> Column:
        return F.regexp_replace(t, "^" + "".join(f"({'.' * n})" for n in map(int, shape.split(","))) + ".*$", SHAPES[form])

    if form in ("dot_card", "slash_card", "slip_card"):  # the last one fails its check digit
        return cut(card(1 if form == "slip_card" else 0), "4,4,4,4")
    if form in ("paren_phone", "dash_phone", "trunk_phone", "plain_phone"):
        return cut(number(10), "3,3,4")
    if form == "pair_phone":
        return cut(number(10), "2,2,2,2,2")
    if form in ("bracket_ip", "spelt_ip", "spaced_ip", "comma_ip", "colon_ip"):
        return F.concat_ws(SHAPES[form], *map(octet, range(4)))
    if form == "long_digits":
        return number(9)
    if form in ("hex32", "hex40", "hex64"):
        return F.substr(draw(0), F.lit(1), F.lit(int(form[3:])))
    if form == "uuid":
        return F.regexp_replace(F.substr(draw(0), F.lit(1), F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    if form == "mixed":
        return F.concat(F.initcap(word(1)), number(4), F.upper(word(2, 5)), number(3, 5), word(3))
    if form == "spelt_mail":
        return F.concat(word(1), F.lit("."), number(2), F.lit(" (at) "), word(2), F.lit(" (dot) com"))
    if form == "wide_mail":
        return F.concat(word(1), number(2), F.lit(" [at] "), word(2), F.lit(".org"))
    if form == "product":
        return F.concat(F.upper(word(1, 1)), F.lit(" @ "), word(2, 1), F.lit("."), word(3))
    return F.concat(number(2), F.lit(" @ "), number(1), F.lit("."), number(2, 5))  # count_at_price


SHAPES = {
    "dot_card": "$1.$2.$3.$4", "slash_card": "$1/$2/$3/$4", "slip_card": "$1.$2.$3.$4",
    "paren_phone": "($1) $2-$3", "dash_phone": "$1-$2-$3", "trunk_phone": "1 ($1) $2-$3", "plain_phone": "$1$2$3", "pair_phone": "$1 $2 $3 $4 $5",
    "bracket_ip": "[.]", "spelt_ip": " (dot) ", "spaced_ip": " . ", "comma_ip": ", ", "colon_ip": ":",
}


def planted(docs: DataFrame, tmp: Scratch) -> DataFrame:
    """Rows as those of ``examples`` from windows of the texts with a plant each, a positive and a negative one a text.

    Of a positive plant's own kind only the candidate that covers it counts; other kinds, and all in a negative one, are negative.
    """
    seed = F.sha2(F.concat_ws("/", F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))), 256)
    choices = {yes: [(k, before, form) for k, words, forms, y in PLANTS if y == yes for form in forms for before in words] for yes in (True, False)}
    d = docs.select("doc_id", F.col("text"), seed.alias("seed")).withColumn("yes", F.explode(F.array(F.lit(True), F.lit(False))))
    d = d.withColumn("draw", F.xxhash64("seed", "yes"))
    at = (F.pmod(F.xxhash64("seed", "yes", F.lit(2)), F.length("text") + 1) + 1).cast("int")
    d = d.withColumns({"left": F.substr("text", at, F.lit(AROUND)), "right": F.substr("text", at + AROUND, F.lit(AROUND))}).drop("text")
    no, before, value = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for yes, of in choices.items():
        pick = F.pmod(F.col("draw"), F.lit(len(of))).cast("int")
        here = F.col("yes") == yes
        no = F.when(here, F.get(F.array(*[F.lit(ALL_KINDS.index(k)) for k, _, _ in of]), pick)).otherwise(no)
        before = F.when(here, F.get(F.array(*[F.lit(b) for _, b, _ in of]), pick)).otherwise(before)
        value = F.when(here, F.get(F.array(*[F.lit(f) for _, _, f in of]), pick)).otherwise(value)
    d = d.withColumns({"no": no, "before": F.concat(F.lit(" "), before, F.when(before != "", " ").otherwise("")), "form": value})
    text = F.lit(None).cast("string")
    for form in sorted({f for _, _, forms, _ in PLANTS for f in forms}):
        text = F.when(F.col("form") == form, made(form, F.col("seed"))).otherwise(text)
    d = d.withColumn("value", text)
    d = d.select("doc_id", "yes", "no", F.concat("left", "before", "value", F.lit(" "), "right").alias("t"), (F.length("left") + F.length("before")).alias("from"), (F.length("left") + F.length("before") + F.length("value")).alias("to"))
    d = tmp.write(d, "plants").withColumn("base", base_spans(F.col("t"))).withColumn("c", F.explode(candidates(F.col("t"))))
    c = F.col("c")
    inside = (c.start < F.col("to")) & (F.col("from") < c.end)
    whole = (c.start == F.col("from")) & (c.end == F.col("to")) & (c.no == F.col("no"))
    other = c.no != F.col("no")
    d = d.where(inside & (~F.col("yes") | whole | other) & ~F.exists("base", lambda b: (b.start < c.end) & (c.start < b.end)))
    return d.select("doc_id", (F.col("yes") & whole).cast("double").alias("label"), F.lit(True).alias("addable"), "c.*").drop("txt")


def fit(docs: DataFrame):
    """(model, threshold a kind) from the examples of all documents, or None without both classes.

    A fifth of the documents is held out: a kind's threshold is the least at which held-out candidates that could be
    added, at or above it, are positive to MIN_PRECISION. Without any the kind adds nothing.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    tmp = Scratch(docs.sparkSession, "op10")
    any_need = F.lit(False)
    for needs in WIDE_NEEDS.values():
        any_need = any_need | F.col("text").rlike(needs)
    rows = tmp.write(examples(docs.where(any_need)).unionByName(planted(docs, tmp)).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5))), "examples")
    seen = {r.label: r.n for r in rows.where("fold > 0").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        tmp.drop()
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.4, seed=5, maxBins=32).fit(vectors.transform(rows.where("fold > 0")).select("features", "label").repartition(n_partitions(docs.sparkSession)))
    held = model.transform(vectors.transform(rows.where("fold = 0 and addable"))).select("no", "label", F.round(vector_to_array("probability")[1], 3).alias("p"))
    table_ = held.groupBy("no", "p").agg(F.sum("label").alias("hit"), F.count("*").alias("n")).collect()  # a thousand scores a kind at most
    tmp.drop()
    limits = []
    for i in range(len(ALL_KINDS)):
        hit = n = 0.0
        best = 2.0  # above any score: nothing is added
        for r in sorted((r for r in table_ if r.no == i), key=lambda r: -r.p):
            hit, n = hit + r.hit, n + r.n
            if hit >= MIN_PRECISION * n and r.p > 0.5:
                best = float(r.p)
        limits.append(best)
    return model, limits


def redactions(docs: DataFrame, fitted=None) -> DataFrame:
    """doc_id, text, base and all spans (start, no, end; code points, end exclusive) of each row.

    Added spans are candidates at their kind's threshold that overlap no base span. ``fitted`` is what ``fit`` returned
    for other documents; without it the trees are fitted on these. Null text is empty; without candidates of both classes
    no span is added; a null doc_id is a document like others, rows that share one are documents of their own. Other
    columns are not read.
    """
    d = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    fitted = fitted or fit(d)
    d = d.withColumn("base", base_spans(F.col("text")))
    if fitted is None:
        return d.withColumn("spans", F.col("base"))
    model, limits = fitted
    least = F.array(*[F.lit(x) for x in limits])
    near = F.filter(candidates(F.col("text")), lambda c: (F.round(tree_column(model, lambda i: c[FEATURES[i]]), 3) >= F.get(least, c.no)) & ~F.exists("base", lambda b: (b.start < c.end) & (c.start < b.end)))
    added = F.transform(near, lambda c: F.struct(c.start.alias("start"), c.no.alias("no"), c.end.alias("end"))).cast(_SPANS)
    return d.withColumn("spans", F.array_sort(F.array_distinct(F.concat("base", added))))


def spelled(spans: str) -> Column:
    kind = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s.no), s.start.cast("string"), s.end.cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = redactions(table(spark, sf_dir, "documents"))

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s.no == i)).cast("long").alias(f"n_{KINDS[i]}")

    return out.select("doc_id", *map(count, range(len(KINDS))), F.sha2(spelled("base").cast("binary"), 256).alias("base_sha256"), spelled("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
