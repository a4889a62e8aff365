"""A session's events folded by columns give what the fold gives one by one, whatever the parts."""

import random
import time

import pandas as pd
import pytest

from tarnwell.operators.state import Session


def events(rnd, n, gap):
    us, rows = 0, []
    for _ in range(n):
        us += rnd.choice([0, 1, gap // 2, gap, gap + 1])
        rows.append((us, rnd.choice(["AS1", "AS2", "", None]), rnd.choice(["mobile", "vpn", "tor", "unknown", None]), rnd.choice(["d1", "d2", "d3", None]), rnd.choice(["a", "b"]), rnd.choice(["g", None, ""]), rnd.choice(["c1", "c2"])))
    return pd.DataFrame(rows, columns=["us", *Session.fields])


@pytest.mark.parametrize("seed", range(40))
def test_columns_are_the_fold(seed):
    rnd = random.Random(seed)
    own, ttl = events(rnd, 200, 10), rnd.choice([5, 10, 1000])
    one, many, got, at = Session(), Session(), [], 0
    want = [one.step(e, ttl) for e in own.astype(object).where(own.notna(), None).to_dict("records")]
    while at < len(own):
        n = rnd.choice([0, 1, 7, 60, 200])
        got += list(zip(*(x.tolist() for x in many.steps(own[at : at + n], ttl)), strict=True))
        at += n
    assert got == want
    assert (one.seen, one.at, one.reported) == (many.seen, many.at, many.reported)


def test_a_long_session_is_folded_soon():
    own = pd.concat([events(random.Random(1), 2000, 10)] * 200, ignore_index=True)
    own["us"] = range(len(own))
    began = time.process_time()
    Session().steps(own, 1000)
    assert time.process_time() - began < 8
