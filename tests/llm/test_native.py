"""The operators that use DataFrame functions alone, against brute force and SQL on small tables."""

import hashlib
import re
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from lakesift.llm import licenses, mixing, quotes, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def by_sql(sql, df):
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return sorted((tuple(zip(names, r)) for r in found.fetchall()), key=str)


def rows_of(df, names):
    return sorted((tuple((c, r[c]) for c in names) for r in df.collect()), key=str)


LICENSE_TEXTS = [
    "Released under the MIT License.",
    "mit license, MIT\tLICENSE; cc by cc by",
    "GNU General Public License",
    "gnu generalK public license",
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the very GNU General Public License, version 3!",
    "a" * 50 + " mit " + "License " * 3,
    "",
    None,
    "...",
    "mit",
    "the the of the software " * 400 + "cc BY",
    "apacheé license apache licenseé apache license",
    "under the MIT license released under",
    "is licensed under the apache license version 2 0 and licensed, licensed under it",
    "licensed under the really very new Apache License, Version 2.0",
    "the apache license version 2 0 licensed under",
]


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    return len(words), found


def test_licenses(spark):
    rows = [(k, t, "s") for k, t in enumerate(LICENSE_TEXTS)] + [(None, "MIT license", None), (1, LICENSE_TEXTS[1], "s")]
    df = documents(spark, rows).withColumn("label", F.lit("x")).withColumn("words", F.lit(1))
    got = licenses.scan(df)
    assert got.count() == len(rows)
    for r in got.collect():
        text = "MIT license" if r["doc_id"] is None else LICENSE_TEXTS[r["doc_id"]]
        n, places = base_places(text)
        starts = [k for k, _ in places]
        assert (r["n_words"], r["n_base"]) == (n, len(places)), text
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in got.collect()}
    assert labels[13] == "mit" and labels[16] == "apache" and "apache-notice" in labels[14] and "apache-notice" in labels[15]
    assert "mit-notice" in labels[0] and "apache-notice" in labels[4] and "gpl-notice" in labels[5]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert rows_of(got, names) == by_sql(licenses.op4_sql(), documents(spark, rows))
    assert licenses.scan(documents(spark, [])).count() == 0


def test_license_plan_has_no_python(spark):
    plan = licenses.scan(documents(spark, [(1, "a", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def filled(sizes):
    """Targets by resharing until none is above its cap, with fractions."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    target, cap = dict.fromkeys(order, Fraction(0)), {s: 2 * sizes[s] for s in order}
    left, open_sources = Fraction(3, 2) * sum(sizes.values()), set(order)
    while left > 0 and open_sources:
        total = sum(weight[s] for s in open_sources)
        for s in open_sources:
            target[s] += left * weight[s] / total
        left = sum(max(Fraction(0), target[s] - cap[s]) for s in open_sources)
        for s in list(open_sources):
            if target[s] >= cap[s]:
                target[s] = Fraction(cap[s])
                open_sources.discard(s)
    return target


MIXES = {
    "plain": [(k, "w " * (k % 7 + 1), f"s{k % 4}") for k in range(200)],
    "hot": [(k, "a b c", "hot" if k % 3 else f"s{k}") for k in range(120)] + [(500, "x " * 5000, "hot")],
    "odd": [(1, None, "a"), (2, "", "a"), (3, "one", None), (None, "two words", "b"), (4, "\x0b\x1c  x", "é"), (5, "z", "Z"), (3, "one", None), (3, "one", None)],
    "copies": [(7, "same text here", "a")] * 9 + [(8, "other", "b")],
}


@pytest.mark.parametrize("name", MIXES)
@pytest.mark.parametrize("per_bucket", [3, 4096])
def test_mixing(spark, name, per_bucket):
    rows = MIXES[name]
    df = documents(spark, rows)
    got = mixing.mix(df, rows_per_bucket=per_bucket).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = filled(sizes)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(float(target[s])) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 0.5
    assert all(0 <= r["taken"] <= 2 * r["size"] and ((r["position"] is not None) == (r["taken"] > 0)) for r in got)
    positions = [r["position"] for r in got if r["position"] is not None]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)
    for r in got:
        assert r["taken"] == 0 or sorted(r["positions"]) == r["positions"] and r["positions"][0] == r["position"]
    assert rows_of(mixing.digest(mixing.mix(df, rows_per_bucket=per_bucket)), mixing.COLUMNS) == by_sql(mixing.OP5_SQL, df)


@pytest.mark.parametrize("budget", [1.5, 2.0, 0.7])
def test_curriculum_follows_the_schedule(spark, budget):
    """The words of all uses follow the integral of a weight that falls from 3 to 1, to 1% at each quarter."""
    df = documents(spark, [(k, "w " * (k % 5 + 1), "a") for k in range(3000)])
    uses = [(p, r["size"]) for r in mixing.mix(df, budget=budget).collect() for p in r["positions"] or []]
    words = sum(n for _, n in uses)
    assert words == pytest.approx(budget * 9000, abs=5)
    for t in (0.25, 0.5, 0.75):
        assert sum(n for p, n in uses if p <= t) / words == pytest.approx((3 * t - t * t) / 2, abs=0.01)


def test_two_sources_share_time_by_their_schedules(spark):
    """Of two sources, one that begins strong and one that doesn't change, each quarter of time has the words that the integrals ask."""
    df = documents(spark, [(k, "w", "ab"[k % 2]) for k in range(4000)])
    uses = [(p, r["source"]) for r in mixing.mix(df, weights=(1,), schedules=((3.0, 1.0), (1.0, 1.0))).collect() for p in r["positions"] or []]
    for source, integral in (("a", lambda t: (3 * t - t * t) / 2), ("b", lambda t: t)):
        mine = [p for p, s in uses if s == source]
        for t in (0.25, 0.5, 0.75):
            assert sum(p <= t for p in mine) / len(mine) == pytest.approx(integral(t), abs=0.01)


def test_mixed_documents(spark):
    df = documents(spark, MIXES["plain"])
    names = ("size", "_size", "_position", "_id", "_copies", "_words", "row", "id", "words", "position", "stream", "place", "taken", "base")
    df = df.withColumns({c: F.lit("clash") for c in names})
    out = mixing.mixed(df)
    assert out.columns == df.columns and {r["_words"] for r in out.collect()} == {"clash"}
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(documents(spark, MIXES["plain"])).collect()}
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for key, (words, size) in taken.items():
        assert abs(counts.get(key, 0) * size - words) <= size / 2 + 1
    assert mixing.mixed(documents(spark, [])).count() == 0 and mixing.mix(documents(spark, [])).count() == 0
    assert sum(r["count"] for r in mixing.mixed(documents(spark, MIXES["copies"])).groupBy("doc_id").count().collect()) > 0


def test_every_use_has_its_position(spark):
    """All uses follow the integral of the weight, and a pass over the source ends before the next one begins."""
    df = documents(spark, [(k, f"w{k}", "a") for k in range(600)])
    times = [p for r in mixing.mix(df, budget=2.0).collect() for p in r["positions"]]
    assert len(times) == 1200
    for t in (0.25, 0.5, 0.75):
        assert sum(p <= t for p in times) / 1200 == pytest.approx((3 * t - t * t) / 2, abs=0.01)
    order = [r["doc_id"] for r in mixing.mixed(df, budget=2.0).collect()]
    assert sorted(order[:600]) == sorted(order[600:]) == list(range(600))
    order = [r["text"] for r in mixing.mixed(documents(spark, [(7, f"w{k}", "a") for k in range(5)]), budget=2.0).collect()]
    assert len(order) == 10 and order[:5] == order[5:] == sorted(order[:5], key=lambda t: hashlib.md5(t.encode()).hexdigest())


def test_lookup_table():
    shards = [f"n{k}" for k in range(5)]
    table = sharding.lookup_table(shards, 101)
    # The same by a plain reading of the rule: whole permutations, one claim a turn.
    orders = []
    for name in shards:
        d = hashlib.md5(name.encode()).hexdigest()
        at, skip = int(d[:15], 16) % 101, int(d[15:30], 16) % 100 + 1
        orders.append([(at + k * skip) % 101 for k in range(101)])
    owner, turn = {}, 0
    while len(owner) < 101:
        owner[next(s for s in orders[turn % 5] if s not in owner)] = turn % 5
        turn += 1
    assert table == [owner[k] for k in range(101)]
    counts = [table.count(k) for k in range(5)]
    assert max(counts) - min(counts) <= 1
    big, less = sharding.lookup_table(), sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(big, less) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.15 * len(big)
    assert sharding.lookup_table(["a"], 2) == [0, 0]
    for bad in ([], ["a", "a"], ["a", "b", "c"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 2)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


def test_placement(spark, tmp_path):
    rows = [(k, "t", "s") for k in range(300)] + [(None, None, None), (5, "again", "s")]
    df = documents(spark, rows).withColumn("shard", F.lit("clash"))
    got = sharding.place(df, "doc_id")
    assert got.count() == len(rows) and got.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "shard", "shard_after"]
    table = sharding.lookup_table()
    for r in got.collect():
        slot = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, table[slot])
    assert rows_of(got, ["doc_id", "slot", "shard", "shard_after"]) == by_sql(sharding.op7_sql(), documents(spark, rows))
    assert sharding.place(documents(spark, []), "doc_id").count() == 0
    sharding.write_shards(df.drop("shard"), "doc_id", str(tmp_path / "out"), ["a", "b"], 11, 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


TALK = "conv_id long, turn long, role string, text string"


def talk(spark, rows):
    return spark.createDataFrame(rows, TALK)


def test_quotes(spark):
    rows = [
        (1, 0, "user", "How do I bake bread?\n\nAnd what of salt?"),
        (1, 1, "assistant", "Use flour.\nSecond line."),
        (1, 2, "user", "On Monday, bot wrote:\n> Use   FLOUR.\n> second line.\n\nWhich flour?"),
        (1, 3, "assistant", ">> use flour. second line.\n> Which flour?\nRye."),
        (1, 4, "user", "> and what of salt?\nstill open"),
        (1, 5, "user", "> nobody said this\nreally"),
        (2, 0, "user", "> Which flour?\nother conversation"),
        (None, 0, "user", "> Rye.\nx"),
        (1, None, "user", "no turn"),
        (3, 0, None, None),
        (3, 0, None, None),
        (3, 1, "user", "> a\n> b"),
        (4, 0, "user", "later"),
        (4, 1, "user", "x\n" * 5000 + "> later\nlast"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.thread(talk(spark, rows)).collect()}
    assert quotes.thread(talk(spark, rows)).count() == len(rows)
    a = got[1, 2]
    assert (a["text"], a["quote_level"], a["n_quotes"], a["n_linked"], a["reply_to"], a["root_turn"], a["depth"]) == ("Which flour?", 1, 1, 1, 1, 1, 1)
    b = got[1, 3]
    assert (b["text"], b["quote_level"], b["n_quotes"], b["n_linked"], b["reply_to"], b["root_turn"], b["depth"]) == ("Rye.", 2, 2, 2, 2, 1, 2)
    assert (got[1, 4]["reply_to"], got[1, 4]["root_turn"], got[1, 4]["text"]) == (0, 0, "still open")
    assert (got[1, 5]["reply_to"], got[1, 5]["n_quotes"], got[1, 5]["n_linked"], got[1, 5]["text"]) == (None, 1, 0, "really")
    assert got[2, 0]["reply_to"] is None and got[None, 0]["text"] == "x" and got[None, 0]["root_turn"] == 0
    assert got[3, 0]["message"] == "<||>\n" and got[3, 1]["text"] == ""
    assert got[4, 1]["reply_to"] == 0 and got[4, 1]["text"].endswith("last")
    assert rows_of(quotes.thread(talk(spark, rows)), TALK_COLUMNS) == talk_by_sql(talk(spark, rows))
    order = [r["turn"] for r in quotes.thread(talk(spark, rows)).collect() if r["conv_id"] == 1 and r["turn"] is not None]
    assert order == [0, 4, 1, 2, 3, 5]


def test_quotes_of_parts(spark):
    long = "We could use the old oven for this. It takes twenty minutes to get hot! Then bake.\nThe second line is about resting the dough for an hour."
    rows = [
        (1, 0, "user", "It takes twenty minutes or so."),
        (1, 1, "assistant", long),
        (1, 2, "user", "> it takes twenty minutes to get hot\nReally?"),
        (1, 3, "user", "> The second line is about resting the dough for an hour.\nWhy?"),
        (1, 4, "user", "> could use the old oven for\nYes."),
        (1, 5, "user", "> Then bake.\nHow long?"),
        (1, 6, "user", "> We could use the new oven for this.\nNobody said that"),
        (1, 7, "user", "On Monday, " + "a very long name " * 20 + "wrote:\n> We could use the old oven\n> for this. It takes\nGood."),
        (2, 0, "user", "> Then bake.\nother conversation"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.thread(talk(spark, rows)).collect()}
    assert [got[1, k]["reply_to"] for k in range(2, 8)] == [1, 1, 1, 1, None, 1] and got[2, 0]["reply_to"] is None
    assert [got[1, k]["n_linked"] for k in range(2, 8)] == [1, 1, 1, 1, 0, 1]
    assert got[1, 7]["text"] == "Good." and got[1, 7]["depth"] == 1


TALK_COLUMNS = ["conv_id", "turn", "role", "text", "quote_level", "n_quotes", "n_linked", "reply_to", "root_turn", "depth", "message"]


def talk_by_sql(df):
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    found = con.execute(quotes.op10_sql())
    names = [c[0] for c in found.description]
    return sorted((tuple((c, r[names.index(c)]) for c in TALK_COLUMNS) for r in found.fetchall()), key=str)


def test_planted_quotes_at_size(spark):
    """Conversations of the test tables in which every later turn quotes an earlier one, at one or two levels; the SQL gives the same rows."""
    base = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    told = {}
    for r in base.orderBy("conv_id", "turn").collect():
        told.setdefault(r["conv_id"], []).append(r)
    rows, expected = [], {}
    for conv, turns in told.items():
        first = {}
        for k, r in enumerate(turns):
            text = r["text"].replace(">", "")
            words = " ".join(text.lower().split())
            quoted = ""
            if k and "\n" not in turns[k - 1]["text"] and turns[k - 1]["text"].strip():
                said = turns[k - 1]["text"].replace(">", "")
                quoted = f"On Monday, {r['role']} wrote:\n> {said}\n" + (">> nobody said this at all\n" if k % 3 == 0 else "") + "\n"
                origin = first.get(" ".join(said.lower().split()))
                expected[conv, r["turn"]] = (origin, 2 if k % 3 == 0 else 1)
            first.setdefault(words, r["turn"])
            rows.append((conv, r["turn"], r["role"], quoted + text))
    df = talk(spark, rows)
    got = quotes.thread(df)
    found = {(r["conv_id"], r["turn"]): r for r in got.where("n_quotes > 0").collect()}
    assert len(expected) > 100 and set(found) == set(expected)
    assert {key: (r["reply_to"], r["quote_level"]) for key, r in found.items()} == expected
    assert all(r["depth"] >= 1 and "wrote:" not in r["text"] for r in found.values() if r["reply_to"] is not None)
    assert rows_of(got, TALK_COLUMNS) == talk_by_sql(df)


def test_long_reply_chain(spark):
    rows = [(1, 0, "user", "word0")] + [(1, k, "user", f"> word{k - 1}\nword{k}") for k in range(1, 40)]
    got = quotes.thread(talk(spark, rows)).collect()
    assert rows_of(quotes.thread(talk(spark, rows)), TALK_COLUMNS) == talk_by_sql(talk(spark, rows))
    assert [(r["turn"], r["root_turn"], r["depth"], r["text"]) for r in got] == [(k, 0, k, f"word{k}") for k in range(40)]


def test_a_passage_that_many_say_and_quote_makes_no_pairs(spark):
    rows = [(1, k, "user", "ok" if k % 2 else "> ok\nok") for k in range(400)]
    got = quotes.thread(talk(spark, rows)).collect()
    assert len(got) == 400 and {r["reply_to"] for r in got if r["n_quotes"] and r["turn"] > 0} == {0}


def test_talk_without_quotes_and_without_rows(spark):
    got = quotes.thread(talk(spark, [(1, 0, "user", "a > b"), (1, 1, "assistant", "c")])).collect()
    assert [(r["text"], r["depth"], r["reply_to"]) for r in got] == [("a > b", 0, None), ("c", 0, None)]
    assert quotes.thread(talk(spark, [])).count() == 0
