"""The chat query's position ids and attention intervals, against brute force on the stream."""

import hashlib

from cladeframe.llm import chat


def test_report_has_masks(spark):
    rows = [(1, 0, "user", "same"), (1, 1, "assistant", "left"), (1, 2, "user", "x"), (1, 3, "assistant", "one")]
    rows += [(2, *r[1:]) for r in rows[:3]] + [(2, 3, "assistant", "another"), (2, 4, "user", "bye")]
    rows += [(3, 0, "user", "same"), (3, 1, "assistant", "right"), (3, 2, "user", "more"), (None, 0, "user", "z"), (None, 1, "assistant", None)]
    rows += [(10 + k, *t) for k in range(8) for t in ((0, "user", "same"), (1, "assistant", f"answer {k}"), (2, "user", "thanks"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.chat_report(df).collect()}
    _, read = chat.format_conversations(df)
    conversations = {r["conv_id"]: r["nodes"] for r in read.collect()}
    assert set(got) == set(conversations) == {r[0] for r in rows}
    gaps = 0
    for c, nodes in conversations.items():
        if c is None:  # rows without an id are conversations of their own, which this dictionary cannot hold
            continue
        lines, n_intervals, position = "", 0, 0
        for k, x in enumerate(nodes):
            # What a token may attend to is the set of its ancestors' places; runs of it are the intervals.
            places = sorted(p for y in nodes[:k] for p in range(y["starts"], y["starts"] + y["n_ids"]))
            edges = [p for p in places if p - 1 not in set(places)], [p + 1 for p in places if p + 1 not in set(places)]
            mask = ",".join(f"{a}:{b}" for a, b in zip(*edges))
            lines += f"{position}:{x['n_ids']}:{hashlib.sha256(mask.encode()).hexdigest()}\n"
            n_intervals += len(edges[0])
            gaps += len(edges[0]) > 1
            position += x["n_ids"]
        r = got[c]
        assert (r["n_nodes"], r["next_position"], r["n_intervals"]) == (len(nodes), position, n_intervals)
        assert r["attention_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
    assert gaps
