"""Pairs of subscribers are made once, where they are given, and never shuffled."""

import io
from contextlib import redirect_stdout
from itertools import combinations

import pytest

from marlstone.operators import places

SCHEMA = "user_id bigint, message_to bigint, channel string, event_type string"


def events(spark):
    subscribed = {u: {f"c{(u * k) % 7}" for k in (1, 2, 3)} | ({"all"} if u % 2 else set()) for u in range(40)}
    rows = [(u, None, c, "subscription") for u, cs in subscribed.items() for c in cs for _ in range(2)]
    sent = [(u, (u * 7 + 3) % 40, None, "message") for u in range(40)] + [(0, v, None, "message") for v in range(1, 30)] + [(5, 99, None, "message")]
    pairs = {(a, b) for a, b in combinations(range(40), 2) if subscribed[a] & subscribed[b]}
    return spark.createDataFrame(rows + sent, SCHEMA), pairs, {(min(a, b), max(a, b)) for a, b, *_ in sent}


@pytest.mark.parametrize("block", [2000, 5])
@pytest.mark.parametrize(("words", "bits"), [(4, 62), (2, 2), (1, 1)])
def test_pairs_once(spark, monkeypatch, block, words, bits):
    """Also where users have more channels than bits."""
    monkeypatch.setattr(places, "WORDS", words)
    monkeypatch.setattr(places, "BITS", bits)
    ev, pairs, known = events(spark)
    assert sorted(map(tuple, places.co_subscribers(ev, block).collect())) == sorted(pairs)
    assert sorted(map(tuple, places.co_subscribers(ev, block, places.contacts(ev)).collect())) == sorted(pairs - known)


def test_pairs_are_not_shuffled(spark):
    """Above the join that makes the pairs there is neither an exchange nor an aggregate nor another join."""
    ev, *_ = events(spark)
    for without in (None, places.contacts(ev)):
        text = io.StringIO()
        with redirect_stdout(text):
            places.co_subscribers(ev, 5, without).explain()
        lines = text.getvalue().splitlines()
        made = next(i for i, x in enumerate(lines) if "Join" in x)
        assert "i#" in lines[made] and "j#" in lines[made]
        assert not [x for x in lines[:made] if "Exchange" in x or "Aggregate" in x]


def _shuffled(spark, df):
    """The result and the number of rows that its stages shuffle."""
    sc = spark.sparkContext
    store = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    wait = lambda: sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    each = lambda found: {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (found.apply(i) for i in range(found.size()))}
    wait()
    before = each(store())
    rows = df.collect()
    wait()
    return rows, sum(n for k, n in each(store()).items() if k not in before)


@pytest.mark.parametrize("known", [False, True])
def test_what_is_shuffled_grows_with_the_users(spark, known):
    """Twice the users of a channel are four times the pairs, but twice the rows that go to the tiles."""
    sent, name = [], "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    for n in (100, 200):
        rows = [(u, (u + 1) % n, "c" if kind == "subscription" else None, kind) for u in range(n) for kind in ("subscription", "message")]
        ev = spark.createDataFrame(rows, SCHEMA)
        out, k = _shuffled(spark, places.co_subscribers(ev, 5, places.contacts(ev) if known else None))
        assert len({tuple(x) for x in out}) == len(out) == n * (n - 1) // 2 - n * known
        sent.append(k)
    spark.conf.set(name, before)
    assert sent[1] < 2.3 * sent[0]
