"""The operators built of DataFrame functions alone: fingerprints, mixing, chat formatting, personal data."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD, SF
from tidemark.llm import chat, fingerprint, mixing, pii
from tidemark.llm.common import Scratch

PYTHON = re.compile("Python|Pandas|Arrow")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def key(i):
    return -(2**63) if i is None else i


def test_fingerprint_contract(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in fingerprint.op4_fingerprints(spark, SF).collect()}
    t = {r.doc_id: r.text or "" for r in rows}
    ids = sorted(t, reverse=True)
    for i, x in enumerate(ids):
        nxt, n = t[ids[(i + 1) % len(ids)]], len(t[x])
        edited = t[x][: n - n // 3] + nxt[: n // 3]
        assert got[x].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[x].n_chars == n
        assert 0 <= got[x].near_next <= 1 and 0 <= got[x].near_edited <= 1
    by_text = {}
    for x, text in t.items():
        by_text.setdefault(text, set()).add(got[x].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def paragraphs(text):
    return {p for p in re.split(r"[.!?]+[ \t\n\x0b\f\r]+|\n", text) if p}


def test_likeness_is_exact(spark):
    """Peeling, its retries and the last resort all count the differing paragraphs."""
    rows = [(i, "\n".join(f"paragraph {j} {'x' * 300 if i % 2 else ''}" for j in range(i, i + 4 * i + 1))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprints(df).collect()}
    for i, t in rows:
        nxt = rows[i - 1][1]
        a, b = paragraphs(t), paragraphs(nxt)
        assert got[i].near_next == pytest.approx(1 - len(a ^ b) / (len(a) + len(b)))


def test_likeness_across_lengths(spark):
    """One rule at every length: texts and their edits, or near copies, are alike whichever limit lies between them."""
    sentences = [f"Sentence number {j} has some words of its own. " for j in range(200)]
    rows = [(2 * n, "".join(sentences[:n])) for n in (4, 15, 20, 22, 24, 30, 60, 150)]
    rows += [(i + 1, t.replace("Sentence number 2 ", "Another one ")) for i, t in rows]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text, ids = dict(rows), sorted(dict(rows), reverse=True)
    for i, x in enumerate(ids):
        t, nxt = text[x], text[ids[(i + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        for other, near in ((edited, got[x].near_edited), (nxt, got[x].near_next)):
            a, b = paragraphs(t), paragraphs(other)
            assert near == pytest.approx(1 - len(a ^ b) / (len(a) + len(b)))
        assert got[x].exact_groups == 0
        if x % 2:
            assert got[x].near_next >= 0.5 and got[x].near_edited >= 0.5


def test_next_of_rows_that_share_an_id(spark):
    """An id that a third of the rows have, and rows without one, are cut by their texts' hash; the order stays whole."""
    rows = [(i if i % 3 else 7, f"text {i}") for i in range(300)] + [(None, f"none {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint.with_next(df).withColumns({"tie": F.xxhash64("text"), "next_tie": F.xxhash64("next.text")}).collect()
    order = sorted(((key(r.doc_id), r.tie, r.text) for r in got), reverse=True)
    after = {t: order[(i + 1) % len(order)][2] for i, (_, _, t) in enumerate(order)}
    assert len(got) == len(rows) and {r.text: r.next.text for r in got} == after


def test_peel_recovers_the_digests(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [3, 4, 5])], "a array<long>, b array<long>")
    found = fingerprint.peel(fingerprint.subtract(fingerprint.sketch(F.col("a"), 8), fingerprint.sketch(F.col("b"), 8)), 8)
    assert {(x.s, x.k) for x in df.select(found.alias("f")).first().f} == {(1, 1), (1, 2), (-1, 5)}


def test_fingerprints_of_odd_rows(odd, none):
    got = fingerprint.fingerprints(odd).collect()
    assert len(got) == len(ODD) and sorted(key(r.doc_id) for r in got) == sorted(key(i) for i, *_ in ODD)
    assert len({r.fingerprint for r in got if r.doc_id in (0, 7)}) == 1
    assert fingerprint.fingerprints(none).count() == 0
    assert not PYTHON.search(plan(fingerprint.fingerprints(odd)))


def filled(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            break
        level = (budget - sum(2 * sizes[s] for s in full)) / sum(w[s] for s in rest)
        over = {s for s in rest if level * w[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    return {s: 2.0 * sizes[s] if s in full else level * w[s] for s in names}


def test_targets_equal_repeated_sharing(spark):
    sizes = {"a": 10, "b": 500, "c": 0, "é": 700, "z": 40, None: 333, "B": 5}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = filled(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 100, 1001):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("x"))
        assert sorted(r.x for r in df.collect()) == list(range(n))


def test_mix_of_documents(spark):
    got = mixing.op8_mixing(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert all(size[i] == n for i, n in zip(got.doc_id, got["size"], strict=True)) and (got.taken <= 2 * got["size"]).all()
    got["source"] = got.doc_id.map(dict(zip(docs.doc_id, docs.source, strict=True)))
    per = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    want = filled(per["size"].to_dict())
    assert all(abs(per.target[s] - want[s]) < 1e-6 and abs(per.taken[s] - want[s]) <= 2 * mixing.BLOCK for s in want)
    again = mixing.op8_mixing(spark, SF).toPandas()
    assert sorted(zip(got.doc_id, got.taken, strict=True)) == sorted(zip(again.doc_id, again.taken, strict=True))


def test_shards_hold_what_they_drew(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)
    tags = spark.createDataFrame([(0, 5000, 3000), (1, 900, 1000), (2, 0, 10), (3, 41, 30)], "no long, n_slots long, n_blocks long")
    counts = mixing.shard_counts(tags, 90)
    rows = counts.collect()
    for no, total in ((0, 5000), (1, 900), (3, 41)):
        own = sorted((r for r in rows if r.no == no), key=lambda r: r.shard)
        assert sum(r.n for r in own) == total
        assert [r["first"] for r in own] == [sum(x.n for x in own[:i]) for i in range(len(own))]
    # multinomial: counts of 5000 draws over 90 shards have a variance of about their mean
    big = [r.n for r in rows if r.no == 0]
    assert len(big) == 90 and 0.6 < sum((x - 5000 / 90) ** 2 for x in big) / 90 / (5000 / 90) < 1.5
    got = mixing.slots(tags, counts).collect()
    held = {}
    for r in got:
        held[r.no, r.shard] = held.get((r.no, r.shard), 0) + 1
    assert held == {(r.no, r.shard): r.n for r in rows}
    assert len({(r.no, r.turn, r.block) for r in got}) == len(got) == 5941  # a block once a pass
    assert {r.block for r in got if r.no == 0 and r.turn == 0} == set(range(3000))
    assert sorted(r.slot for r in got if r.no == 1) == list(range(900))


def test_taken_is_what_the_shards_hold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = mixing.shard_pieces(docs).collect()
    by = {}
    for r in pieces:
        if r.shard is not None:
            by[r.doc_id] = by.get(r.doc_id, 0) + r.n
    assert {r.doc_id: r.taken for r in mixing.mix(docs).collect()} == {r.doc_id: by.get(r.doc_id, 0) for r in pieces}
    slots = {}
    for r in pieces:
        if r.shard is not None:
            slots.setdefault((r.no, r.slot), []).append(r)
    words = {r.doc_id: r.size for r in pieces}
    assert all(sum(r.n for r in s) <= mixing.BLOCK and len({r.block for r in s}) == 1 for s in slots.values())
    assert all(0 <= r["first"] and r["first"] + r.n <= words[r.doc_id] for s in slots.values() for r in s)
    mixed = {}
    for r in mixing.mixed_documents(docs).collect():
        mixed.setdefault(r.doc_id, []).append(len((r.text or "").split()))
    assert {i: sum(v) for i, v in mixed.items() if sum(v)} == by


def test_mix_of_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and all(r.taken <= 2 * r.size for r in got)
    docs = mixing.mixed_documents(odd)
    assert docs.columns == odd.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect())
    assert words == sum(r.taken for r in got)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert not PYTHON.search(plan(docs)) and not PYTHON.search(plan(mixing.mix(odd)))


def test_chats_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.sql(chat.OP9_SQL).df().sort_values("conv_id").reset_index(drop=True)
    got = chat.op9_chat(spark, SF).toPandas().sort_values("conv_id").reset_index(drop=True)
    assert got[list(want.columns)].equals(want)


def test_branches_of_a_tree(spark):
    rows = [
        (1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "poor", 0.1), (1, 3, 1, "assistant", "good # </turn> \\b", 0.9), (1, 4, 3, "us:er", "### more", 0.2), (1, 5, 2, "user", "x", 0.1),
        (2, 9, 3, "user", "orphan", None), (3, 1, 1, "user", "own parent", 1.0), (None, 1, None, "user", "nobody's", 1.0), (4, 1, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double").withColumn("leaf", F.lit(7)).withColumn("back", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(df).withColumn("turns", chat.parse_turns(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "root"), ("assistant", "good # </turn> \\b"), ("us:er", "### more")]
    assert set(got) == {1, 2, 3, 4} and [(t.role, t.text) for t in got[4].turns] == [("", "")]
    both = chat.format_chats(df, top=2)
    assert both.where("conv_id = 1").count() == 2 and not PYTHON.search(plan(both))
    assert chat.format_chats(df.limit(0)).count() == 0


def test_a_long_chain(spark):
    df = spark.range(300).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    r = chat.format_chats(chat.linear_messages(df)).withColumn("turns", chat.parse_turns(F.col("formatted"))).collect()
    assert len(r) == 1 and [t.text for t in r[0].turns] == [f"t{i}" for i in range(300)]


def test_chats_of_odd_rows(spark):
    """Repeated rows are turns of their own, in order of role and text; a very long text comes back whole."""
    long = "# < \\ word " * 60_000
    rows = [(1, 0, "user", "hello"), (1, 0, "user", "hello"), (1, 1, "assistant", long), (1, None, "assistant", None), (2, 3, None, None), (2, 3, None, None), (3, 1, "assistant", ""), (None, 1, "user", "nobody's")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"msg_id": F.lit("clash"), "score": F.lit("x"), "leaf": F.lit(1)})
    linear = chat.linear_messages(df.where("conv_id is not null").fillna("", ["role", "text"]))
    got = {r.conv_id: r for r in chat.format_chats(linear).withColumn("turns", chat.parse_turns(F.col("formatted"))).collect()}
    assert {i: [(t.role, t.text) for t in r.turns] for i, r in got.items()} == {
        1: [("assistant", ""), ("user", "hello"), ("user", "hello"), ("assistant", long)],
        2: [("", ""), ("", "")],
        3: [("assistant", "")],
    }
    learnt = ["".join(chr(c) for c in map(ord, got[1].formatted[x.start : x.start + x.n])) for x in got[1].loss_spans]
    assert [x.replace("\\h", "#").replace("\\l", "<").replace("\\b", "\\") for x in learnt] == ["", long]


# The contract's patterns, as Python has them.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base(text):
    out = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if valid(k, m[0])]
    return ",".join(f"{pii.KINDS[i]}:{a}:{b}" for a, i, b in sorted(out))


TEXTS = [
    "é mail a.b+c@d-e.fr, x@y.z.", "10.0.0.256 1.2.3.4.5 0001.02.3.255 99999999999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 79927398713 6011000990139424",
    "+1 (988) 555-2485 +12 345 +1234567890123456 call +49-30-1234567.", "🎉 +1 988 555 2485 a@b 1..2", "4" * 3000, "1 " * 2000, "", None, "a@b.c" * 50,
]


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("c", F.lit(2))
    out = pii.redactions(df)
    assert not PYTHON.search(plan(out))
    got = {r.doc_id: (r.b, r.s) for r in out.select("doc_id", pii.spelled("base").alias("b"), pii.spelled("spans").alias("s")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i][0] == base(t or ""), (i, t)
        assert set(got[i][0].split(",")) <= set(got[i][1].split(","))


def planted_texts():
    import random

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randint(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    number = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))

    def card():
        d = number(15)
        return d + next(c for c in "0123456789" if (sum(int(x) if i % 2 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(d)) + int(c)) % 10 == 0)

    def octets():
        return [str(rnd.randint(1, 255)) for _ in range(4)]

    forms = {
        "email": (lambda: f"{word()}.{number(2)}@{word()}.example.com", lambda: f"{word()}.{number(2)} (at) {word()}.example (dot) com"),
        "ip": (lambda: ".".join(octets()), lambda: "[.]".join(octets())),
        "card": (card, lambda: ".".join(re.findall("....", card()))),
        "phone": (lambda: f"+1 ({number(3)}) 555-{number(4)}", lambda: f"1 ({number(3)}) 555-{number(4)}"),
        "secret": (lambda: f'token = "{rnd.randbytes(20).hex()}"', lambda: f"value {rnd.randbytes(20).hex()}"),
    }
    rows = []
    for i in range(1500):
        kind = [*forms, None][i % 6]
        what = number(rnd.choice([9, 10, 16])) if kind is None else forms[kind][i >= 1200]()
        if kind is None and sum(int(x) if j % 2 else sum(divmod(2 * int(x), 10)) for j, x in enumerate(what)) % 10 == 0:
            what = what[:9]  # no card by chance
        rows.append((i, f"{words(rnd.randint(4, 30))} {what} {words(rnd.randint(4, 30))}", kind))
    return rows


def test_forms_beyond_the_base_are_added_and_clean_texts_left_alone(spark):
    rows = planted_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = {r.doc_id: (r.b, r.s) for r in pii.redactions(df).select("doc_id", pii.spelled("base").alias("b"), pii.spelled("spans").alias("s")).collect()}
    caught = {}
    for i, _, kind in rows:
        b, s = got[i]
        if kind is None:
            assert not s, (i, rows[i][1], s)
        elif i >= 1200 or kind == "secret":
            assert not b or kind == "secret"  # digits of a token may be a card number by chance
            caught.setdefault(kind, []).append(f"{kind}:" in s)
    shares = {k: sum(v) / len(v) for k, v in caught.items()}
    print("caught beyond the base", shares)
    assert set(shares) == set(pii.ALL_KINDS) and min(shares.values()) >= 0.9


def lookalikes():
    """(kind, text, value, whether it is personal data): the same forms where words tell what they are, in new sentences."""
    import random

    rnd = random.Random(8)
    number = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))

    def card():
        d = "5" + number(14)
        c = next(c for c in range(10) if (sum(int(x) if i % 2 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(d)) + c) % 10 == 0)
        return ".".join(re.findall("....", d + str(c)))

    forms = {
        "ip": lambda: "[.]".join(str(rnd.randint(1, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: f"({number(3)}) {number(3)}-{number(4)}",
        "bare": lambda: number(10),
        "secret": lambda: rnd.randbytes(20).hex(),
    }
    says = {
        "ip": (("The host was {} all day.", "Seen from {} twice."), ("Now on firmware {} everywhere.", "Upgrade to version {} first.")),
        "card": (("Please use my visa {} for it.", "Her credit card is {} I think."), ("Your order no. {} has left.", "See invoice {} attached.")),
        "phone": (("You may call me at {} later.", "My mobile is {} at work."), ("Ask for part no. {} there.", "The sku is {} in red.")),
        "bare": (("Then dial {} and wait.", "Her phone is {} since May."), ("It took {} steps to end.", "Some {} grains were counted.")),
        "secret": (("The password is {} for now.", "Set the token to {} today."), ("Reverted in commit {} again.", "Its checksum is {} still.")),
    }
    rows = []
    for i in range(600):
        kind = [*forms][i % 5]
        yes = i // 5 % 2 == 0
        value = forms[kind]()
        rows.append(("phone" if kind == "bare" else kind, says[kind][not yes][i // 10 % 2].format(value), value, yes))
    return rows


def test_context_decides_where_form_cannot(spark):
    """Trees fitted on the given documents, on sentences they never saw: better than the rule on forms alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = lookalikes()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, kind string, text string, value string, yes boolean")
    rule = F.lit(None).cast("boolean")
    for k in pii.ALL_KINDS:
        rule = F.when(F.col("kind") == k, pii.plausible(k, F.col("value"))).otherwise(rule)
    by_rule = {r.doc_id: r.rule for r in df.select("doc_id", rule.alias("rule")).collect()}
    got = {r.doc_id: r.s for r in pii.redactions(df, fitted=pii.fit(docs)).select("doc_id", pii.spelled("spans").alias("s")).collect()}
    right, ruled = {}, {}
    for i, (kind, text, value, yes) in enumerate(rows):
        at = text.index(value)
        hit = f"{kind}:{at}:{at + len(value)}" in got[i].split(",")
        right.setdefault((kind, yes), []).append(hit == yes)
        ruled.setdefault((kind, yes), []).append(by_rule[i] == yes)
    share = lambda d: sum(map(sum, d.values())) / len(rows)
    print({k: sum(v) / len(v) for k, v in right.items()}, share(right), share(ruled))
    assert share(right) >= 0.9 and share(right) > share(ruled) + 0.2
    assert min(sum(v) / len(v) for v in right.values()) >= 0.8


def test_plants_cover_every_kind_and_class(spark):
    """Each plant is found by a generator of its kind, and no label comes from the rule on forms."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("plain words on both sides of a plant, nothing else at all").alias("text"))
    tmp, other = Scratch(spark, "plants"), Scratch(spark, "plants")
    rows = pii.planted(docs, tmp).groupBy("no", "label").count().collect()
    assert {(r.no, r.label) for r in rows} == {(i, y) for i in range(len(pii.ALL_KINDS)) for y in (0.0, 1.0)}
    assert pii.planted(docs.limit(0), other).count() == 0
    tmp.drop()
    other.drop()


def test_trees_as_a_column(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    df = spark.range(400).selectExpr("cast(id % 17 as double) a", "cast(id % 5 as double) b", "cast(id * 7 % 11 as double) c")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df.selectExpr("*", "cast(a > 8 and b < 3 or c = 4 as double) label"))
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(df)
    rows = model.transform(df).select(vector_to_array("probability")[1].alias("want"), pii.tree_column(model, lambda i: F.col("abc"[i])).alias("got")).collect()
    assert all(r.want == pytest.approx(r.got) for r in rows) and len({r.want for r in rows}) > 4


def test_pii_contract(spark):
    got = {r.doc_id: r for r in pii.op10_pii(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        b = base(r.text or "")
        assert got[r.doc_id].base_sha256 == hashlib.sha256(b.encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k in pii.KINDS] == [b.count(f"{k}:") for k in pii.KINDS]


def test_pii_of_odd_rows(odd, none):
    got = pii.redactions(odd).select("doc_id", "text", pii.spelled("base").alias("b"), pii.spelled("spans").alias("s")).collect()
    assert sorted(((key(r.doc_id), r.text) for r in got)) == sorted(((key(i), t or "") for i, t, _ in ODD))
    assert all(r.b == r.s == "" for r in got)
    assert pii.redactions(none).count() == 0


def test_mixing_does_not_depend_on_the_session(spark):
    """The same words are taken of every document under any number of shuffle partitions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    held, taken = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("4", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            taken.append(sorted(map(str, mixing.mix(docs).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert taken[0] == taken[1]


def test_trees_are_fitted_on_all_documents(spark, monkeypatch):
    seen = {}

    class Enough(Exception):
        pass

    def count(docs, _tmp):
        seen["rows"] = docs.count()
        raise Enough

    monkeypatch.setattr(pii, "planted", count)
    docs = spark.range(20_500).selectExpr("if(id % 100 = 0, null, id) as doc_id", "'call 555' as text")
    with pytest.raises(Enough):
        pii.fit(docs)
    assert seen["rows"] == 20_500
