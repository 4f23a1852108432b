"""Lifecycles of a stream of revisions: the state of a page is the set of statements that are there."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "page string, p string, o string, cdate timestamp, cuser string, ddate timestamp, duser string"


def close_lifecycles(revisions: DataFrame) -> DataFrame:
    """Closed lifecycles of streamed revisions (page, ord, ts, user, triples array<struct<p,o>>).

    A page's state maps each statement that is there to who added it and when; a revision without it closes the row.
    Rows of a micro-batch are read by ord; the order between batches is that of arrival. What is still there stays in
    the state and gives no row.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        there = {tuple(k): v for k, v in json.loads(state.get[0])} if state.exists else {}
        closed = []
        rows = pd.concat(list(frames)).sort_values("ord", kind="stable")
        for ts, user, triples in zip(rows["ts"], rows["user"], rows["triples"], strict=True):
            now = {(t["p"], t["o"]) for t in triples}
            for k in [k for k in there if k not in now]:
                c = there.pop(k)
                closed.append((key[0], *k, pd.Timestamp(c[0]), c[1], ts, user))
            for k in now - there.keys():
                there[k] = (ts.isoformat(), user)
        state.update((json.dumps(sorted(([list(k), v] for k, v in there.items()))),))
        yield pd.DataFrame(closed, columns=[c.split()[0] for c in OUT.split(", ")])

    return revisions.groupBy("page").applyInPandasWithState(step, OUT, "there string", "append", GroupStateTimeout.NoTimeout)
