"""Row-by-row evaluator of the profile rules, for comparison on small inputs only."""

import math

NULL = None


def scale_row(values):
    row = list(values)
    for i in range(len(row)):
        present = [v for v in row if v is not NULL]
        if row[i] is NULL:
            continue
        low, high = min(present), max(present)
        row[i] = NULL if high == low else (row[i] - low) / (high - low)
    return row


def author_numbers(rows, n_tags, anchor=None, fallback=None):
    """Unscaled numbers per author of one context; `anchor` is the current message."""
    out = {}
    for author in {r["author"] for r in rows if r["author"] is not None}:
        mine = [r for r in rows if r["author"] == author]
        ts = [r["ts"] for r in mine]
        old = [r for r in mine if r is not anchor]
        if anchor is not None and author == anchor["author"] and not old:
            sums = [0.0 if v is NULL else v for v in fallback]
        else:
            sums = [float(sum(r["tags"][i] for r in old)) for i in range(n_tags)]
        total = sum(sums)
        out[author] = {
            "num_comment": float(len(mine)),
            "min_ts": min(ts),
            "sending_rate": (max(ts) - min(ts)) / len(mine),
            "avg_word_text": sum(r["words"] for r in mine) / len(mine),
            "tags": sums,
            "diversity": 0.0 if total == 0 else 1 - max(sums) / total,
            "avg_tag_msg": total / len(mine),
        }
    return out


def scaled(numbers, author):
    me = dict(numbers[author])
    for name in ("num_comment", "min_ts", "sending_rate", "avg_word_text", "avg_tag_msg"):
        column = [n[name] for n in numbers.values()]
        low, high = min(column), max(column)
        me[name] = 1.0 if high == low else (me[name] - low) / (high - low)
    tags = scale_row(me["tags"])
    return [
        1 - me["min_ts"], me["num_comment"], me["sending_rate"], me["avg_word_text"],
        *tags, me["diversity"], me["avg_tag_msg"],
    ]


def forum(rows, n_tags):
    numbers = author_numbers(rows, n_tags)
    return {a: scaled(numbers, a) for a in numbers}


def default(profiles):
    out = []
    for column in zip(*profiles.values()):
        present = [v for v in column if v is not NULL]
        out.append(sum(present) / len(present) if present else NULL)
    return out


def context(rows, anchor, level):
    thread = [r for r in rows if r["tree_id"] == anchor["tree_id"]]
    if level == "tree":
        return [r for r in thread if r["message_id"] <= anchor["message_id"]]
    by_id = {r["message_id"]: r for r in thread}
    path, at = [], anchor
    while at is not None:
        path.append(at)
        at = by_id.get(at["parent"])
    return path


def message_profile(rows, anchor, level, n_tags, forum_profiles, default_profile):
    source = forum_profiles.get(anchor["author"], default_profile)
    fallback = source[4 : 4 + n_tags]
    numbers = author_numbers(context(rows, anchor, level), n_tags, anchor, fallback)
    return scaled(numbers, anchor["author"])


def close(a, b, tol=1e-9):
    if a is NULL or b is NULL:
        return a is b
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)
