"""The registered queries as plain SQL, written row by row: contexts are listed pair by pair."""

from __future__ import annotations

import re

from .plans.design import behaviour_names
from .schema import ANNOTATED_TAGS, N_FOLDS, TAG_CATEGORY, TAGS, profile_columns

N = len(TAGS)
D = 64
T = range(N)
SCALED = ["num_comment", "min_ts", "sending_rate", "avg_word_text", "avg_tag_msg"]

# white space as in functions/text.py
SPACE = (
    r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
WORDS = f"list_filter(regexp_split_to_array(text, '{SPACE}'), lambda w: w <> '')"


def r(x: str, name: str = "") -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0" + (f" AS {name}" if name else "")


def f32(x: str, name: str) -> str:
    return f"round(CAST(CAST({x} AS FLOAT) AS DOUBLE), 6) + 0.0 AS {name}"


def q(name: str) -> str:
    return f'"{name}"'


def commas(items) -> str:
    return ", ".join(items)


def tag_list(x: str = "t{}") -> str:
    return "[" + commas(x.format(i) for i in T) + "]"


def total(x: str) -> str:
    return "(" + " + ".join(f"{x}[{i + 1}]" for i in T) + ")"


def scaled_row(x: str) -> str:
    """Scale the elements one after the other; the reduce walks over [row, [1], [2], ...]."""
    steps = commas(f"[{i + 1}.0::DOUBLE]" for i in T)
    return (
        f"list_reduce(list_concat([{x}], [{steps}]), lambda acc, e: list_transform(acc, lambda v, j: "
        "CASE WHEN j = e[1]::INT THEN (v - list_min(acc)) / nullif(list_max(acc) - list_min(acc), 0) "
        "ELSE v END))"
    )


def minmax(x: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {hi} - {lo} = 0 THEN 1.0 ELSE ({x} - {lo}) / nullif({hi} - {lo}, 0) END"


def profile(source: str, keys: list[str], part: str) -> str:
    """Scale the rows of `source` within `part`."""
    over = f"OVER (PARTITION BY {part})"
    s = {c: minmax(c, f"min({c}) {over}", f"max({c}) {over}") for c in SCALED}
    return f"""SELECT {commas(keys)}, 1 - ({s['min_ts']}) AS duration, {s['num_comment']} AS num_comment,
      {s['sending_rate']} AS sending_rate, {s['avg_word_text']} AS avg_word_text, sums,
      diversity, {s['avg_tag_msg']} AS avg_tag_msg FROM {source}"""


def finish(source: str, keys: list[str]) -> str:
    return f"""SELECT {commas(keys)}, duration, num_comment, sending_rate, avg_word_text,
      {scaled_row('sums')} AS tags, diversity, avg_tag_msg FROM {source}"""


DIVERSITY = f"coalesce(1 - list_max(sums) / nullif({total('sums')}, 0), 0)"
NUMBERS = """count(*)::DOUBLE AS num_comment, min({m}ts) AS min_ts,
  (max({m}ts) - min({m}ts)) / count(*) AS sending_rate, sum({m}words)::DOUBLE / count(*) AS avg_word_text"""


def forum(name: str, rows: str) -> list[tuple[str, str]]:
    """`rows` has fit and the message columns."""
    sums = tag_list("sum(tags[{}])::DOUBLE")
    sums = "[" + commas(f"sum(tags[{i + 1}])::DOUBLE" for i in T) + "]"
    return [
        (f"{name}_a", f"SELECT fit, author, {NUMBERS.format(m='')}, {sums} AS sums FROM ({rows}) WHERE author IS NOT NULL GROUP BY fit, author"),
        (f"{name}_b", f"SELECT *, {DIVERSITY} AS diversity, {total('sums')} / num_comment AS avg_tag_msg FROM {name}_a"),
        (f"{name}_c", profile(f"{name}_b", ["fit", "author"], "fit")),
        (name, finish(f"{name}_c", ["fit", "author"])),
        (f"{name}_default", f"""SELECT fit, avg(duration) AS duration, avg(num_comment) AS num_comment,
           avg(sending_rate) AS sending_rate, avg(avg_word_text) AS avg_word_text,
           [{commas(f'avg(tags[{i + 1}])' for i in T)}] AS tags, avg(diversity) AS diversity,
           avg(avg_tag_msg) AS avg_tag_msg FROM {name} GROUP BY fit"""),
    ]


def contexts(name: str, pairs: str, forum_name: str, fits: str) -> list[tuple[str, str]]:
    """`pairs` has anchor and member; `fits` lists the fits."""
    history = "[" + commas(
        f"coalesce(sum(m.tags[{i + 1}]) FILTER (WHERE m.message_id <> a.message_id), 0)::DOUBLE" for i in T
    ) + "]"
    return [
        (f"{name}_a", f"""SELECT a.message_id AS anchor, a.author AS anchor_author, m.author AS author,
            {NUMBERS.format(m='m.')}, count(*) FILTER (WHERE m.message_id <> a.message_id) AS old,
            {history} AS history
          FROM {pairs} p JOIN msgs a ON a.message_id = p.anchor JOIN msgs m ON m.message_id = p.member
          WHERE m.author IS NOT NULL AND a.author IS NOT NULL
          GROUP BY a.message_id, a.author, m.author"""),
        (f"{name}_b", f"""SELECT k.fit, c.* EXCLUDE (history),
            CASE WHEN c.old > 0 THEN c.history
                 ELSE list_transform(coalesce(f.tags, d.tags), lambda v: coalesce(v, 0)) END AS sums
          FROM {name}_a c CROSS JOIN {fits} k
          LEFT JOIN {forum_name} f ON f.fit = k.fit AND f.author = c.author
          JOIN {forum_name}_default d ON d.fit = k.fit"""),
        (f"{name}_c", f"SELECT *, {DIVERSITY} AS diversity, {total('sums')} / num_comment AS avg_tag_msg FROM {name}_b"),
        (f"{name}_d", profile(f"{name}_c", ["fit", "anchor", "anchor_author", "author"], "fit, anchor")),
        (name, finish(f"(SELECT * FROM {name}_d WHERE author = anchor_author)", ["fit", "anchor AS message_id", "author"])),
    ]


def flat(prefix: str = "", suffix: str = "", narrow: bool = False, base: str | None = None) -> str:
    """Profile columns; with `base`, taken from there where `prefix` has no row."""
    out = []
    for c in profile_columns():
        def at(p, c=c):
            return f"{p}tags[{TAGS.index(c) + 1}]" if c in TAGS else f"{p}{c}"
        x = at(prefix) if base is None else f"CASE WHEN {prefix}fit IS NULL THEN {at(base)} ELSE {at(prefix)} END"
        out.append((f32 if narrow else r)(x, q(c + suffix)))
    return commas(out)


FLAGS = (
    f"list_transform(range(0, {len(ANNOTATED_TAGS)}), lambda i: CASE WHEN (event_id * 7919 + i * 104729 "
    "+ (event_id % 13) * i * 31) % 97 < 5 THEN 1 ELSE 0 END)"
)

CATEGORIES = commas(f"({i}, '{t}', '{TAG_CATEGORY[t]}')" for i, t in enumerate(TAGS))

CTES: list[tuple[str, str]] = [
    ("docs", f"SELECT doc_id, text, len({WORDS})::BIGINT AS words FROM documents"),
    ("cuts", """SELECT *, event_id % 50 AS place, 10 + ((event_id // 50) * 7) % 41 AS first_size FROM events"""),
    ("flagged", f"""SELECT *, CASE WHEN place < first_size THEN place ELSE place - first_size END AS pos,
        2 * (event_id // 50) + CASE WHEN place < first_size THEN 0 ELSE 1 END AS tree_id, {FLAGS} AS flags FROM cuts"""),
    ("msgs", """SELECT event_id AS message_id, event_id::VARCHAR AS node_id, tree_id,
        CASE WHEN pos = 0 THEN -1 ELSE event_id - pos + (pos - 1) // 2 END::BIGINT AS parent,
        'u' || (user_id % 20)::VARCHAR || CASE WHEN event_id % 7 = 0 THEN '_t' || tree_id::VARCHAR ELSE '' END AS author,
        epoch_us(ts)::DOUBLE / 1000000::DOUBLE AS ts, d.text, d.words,
        list_append(flags, CASE WHEN list_max(flags) = 0 THEN 1 ELSE 0 END)::INTEGER[] AS tags
      FROM flagged JOIN docs d ON d.doc_id = event_id % (SELECT count(*) FROM documents)"""),
    ("convs", """SELECT conv_id * 4294967296 + turn AS message_id, conv_id AS tree_id,
        CASE WHEN turn = 0 THEN -1 ELSE conv_id * 4294967296 + turn - 1 END AS parent FROM conversations"""),
    ("closure", """SELECT message_id AS anchor, message_id AS member, parent AS up, 0::BIGINT AS steps FROM msgs
      UNION ALL SELECT c.anchor, m.message_id, m.parent, c.steps + 1 FROM closure c JOIN msgs m ON m.message_id = c.up"""),
    ("conv_closure", """SELECT message_id AS anchor, message_id AS member, parent AS up, 0::BIGINT AS steps FROM convs
      UNION ALL SELECT c.anchor, m.message_id, m.parent, c.steps + 1 FROM conv_closure c JOIN convs m ON m.message_id = c.up"""),
    ("tree_pairs", """SELECT a.message_id AS anchor, b.message_id AS member FROM msgs a JOIN msgs b
      ON a.tree_id = b.tree_id AND b.message_id <= a.message_id"""),
    ("threads", "SELECT tree_id, count(*) AS thread_size FROM msgs GROUP BY tree_id"),
    ("dealt", "SELECT *, row_number() OVER (ORDER BY thread_size DESC, md5(tree_id::VARCHAR)) AS rn FROM threads"),
    ("deal", f"""SELECT 0::BIGINT AS rn, NULL::BIGINT AS tree_id, 0::BIGINT AS thread_size, NULL::INTEGER AS fold,
        [{commas(['0'] * N_FOLDS)}]::BIGINT[] AS loads
      UNION ALL SELECT t.rn, t.tree_id, t.thread_size, (list_position(d.loads, list_min(d.loads)) - 1)::INTEGER,
        list_transform(d.loads, lambda x, i: CASE WHEN i = list_position(d.loads, list_min(d.loads))
          THEN x + t.thread_size ELSE x END)
      FROM deal d JOIN dealt t ON t.rn = d.rn + 1"""),
    ("folds", "SELECT tree_id, thread_size, fold FROM deal WHERE rn > 0"),
    ("fits", f"SELECT unnest(range(0, {N_FOLDS}))::INTEGER AS fit"),
    ("placed", "SELECT m.*, f.fold FROM msgs m JOIN folds f USING (tree_id)"),
    ("rows_", """SELECT k.fit, CASE WHEN p.fold = k.fit THEN 'test' ELSE 'train' END AS split, p.*
      FROM placed p CROSS JOIN fits k"""),
    ("one_fit", "SELECT -1 AS fit"),
    *forum("forum", "SELECT -1 AS fit, * FROM msgs"),
    *contexts("tree", "tree_pairs", "forum", "one_fit"),
    *contexts("branch", "closure", "forum", "one_fit"),
    *forum("fit_forum", "SELECT * FROM rows_ WHERE split = 'train'"),
    *contexts("fit_tree", "tree_pairs", "fit_forum", "fits"),
    *contexts("fit_branch", "closure", "fit_forum", "fits"),
    ("loo_a", """SELECT b.fit, b.anchor, b.author, p.split = 'train' AS trained, p.tags AS own,
        coalesce(a.num_comment, 0) - (p.split = 'train')::INTEGER AS others, a.sums AS whole
      FROM fit_tree_b b JOIN rows_ p ON p.fit = b.fit AND p.message_id = b.anchor
      LEFT JOIN fit_forum_a a ON a.fit = b.fit AND a.author = b.author
      WHERE b.author = b.anchor_author AND b.old = 0"""),
    ("loo_b", f"""SELECT *, CASE WHEN trained THEN [{commas(f'whole[{i + 1}] - own[{i + 1}]' for i in T)}]
        ELSE whole END AS rest FROM loo_a"""),
    ("loo_c", f"""SELECT s.fit, s.author, [{commas(f'avg(o.tags[{i + 1}])' for i in T)}] AS tags
      FROM (SELECT DISTINCT fit, author FROM loo_b WHERE others = 0) s
      JOIN fit_forum o ON o.fit = s.fit AND o.author <> s.author GROUP BY s.fit, s.author"""),
    ("loo", f"""SELECT b.fit, b.anchor, CASE WHEN b.others > 0 THEN {scaled_row('b.rest')} ELSE c.tags END AS sums
      FROM loo_b b LEFT JOIN loo_c c ON c.fit = b.fit AND c.author = b.author"""),
    ("vectors", """SELECT m.message_id, m.tree_id, m.author, v.embedding FROM msgs m
      JOIN embeddings v ON v.vec_id = m.message_id % (SELECT count(*) FROM embeddings)"""),
    ("cats", f"SELECT * FROM (VALUES {CATEGORIES}) AS c(tag_pos, tag, category)"),
    ("long", f"""SELECT message_id, fold, i::INTEGER AS tag_pos, tags[i + 1] AS y,
        ((message_id * 31 + i * 17) % 100)::DOUBLE / 100.0 AS p
      FROM placed, (SELECT unnest(range(0, {N})) AS i)"""),
    ("counts", """SELECT fold, tag_pos, sum(CASE WHEN p > 0.5 THEN y ELSE 0 END)::DOUBLE AS tp,
        count(*) FILTER (WHERE p > 0.5) AS found, sum(y)::BIGINT AS support FROM long GROUP BY fold, tag_pos"""),
    ("prf", """SELECT fold, tag_pos, coalesce(tp / nullif(found, 0), 0) AS precision,
        coalesce(tp / nullif(support, 0), 0) AS recall,
        coalesce(2 * tp / nullif(found + support, 0), 0) AS f1, support FROM counts"""),
    ("weights", """SELECT *, coalesce(support::DOUBLE / nullif(category_support, 0), 0) AS weight FROM (
        SELECT prf.*, tag, category, (sum(support) OVER (PARTITION BY fold, category))::BIGINT AS category_support
        FROM prf JOIN cats USING (tag_pos))"""),
    ("f1s", """SELECT fold, avg(f1) AS macro_f1, coalesce(sum(f1 * support) / nullif(sum(support), 0), 0) AS weighted_f1
      FROM prf GROUP BY fold"""),
    ("loss", """SELECT fold, avg(-(y * ln(c) + (1 - y) * ln(1.0 - c))) AS loss FROM (
        SELECT fold, y, least(greatest(p, 1e-7), 1.0 - 1e-7) AS c FROM long) GROUP BY fold"""),
    ("best", """SELECT fold, message_id, first(tag_pos ORDER BY y DESC, tag_pos) AS truth,
        first(tag_pos ORDER BY p DESC, tag_pos) AS guess FROM long GROUP BY fold, message_id"""),
    ("accuracy", "SELECT fold, avg((truth = guess)::INTEGER) AS accuracy FROM best GROUP BY fold"),
    ("cat_f1", """SELECT category, avg(f1) AS macro_f1, avg(f1 * weight) AS weighted_mean,
        sum(f1 * weight) / count(DISTINCT fold) AS weighted_sum FROM weights GROUP BY category"""),
    ("results", """SELECT 'Loss' AS metric, avg(loss) AS value FROM loss
      UNION ALL SELECT 'Accuracy', avg(accuracy) FROM accuracy
      UNION ALL SELECT 'Macro F1-score', avg(macro_f1) FROM f1s
      UNION ALL SELECT 'Weighted F1-score', avg(weighted_f1) FROM f1s
      UNION ALL SELECT 'Macro F1-' || category, macro_f1 FROM cat_f1
      UNION ALL SELECT 'Weighted F1-' || category, weighted_mean FROM cat_f1"""),
]

# read by every step of a recursion, so computed once
ONCE = {"msgs", "dealt"}

def sql(body: str, more: list[tuple[str, str]] | None = None) -> str:
    """The query after the tables it needs, directly or through others, and no others."""
    tables = dict(CTES) | dict(more or [])
    order, wanted = list(tables), set()
    work = [body]
    while work:
        words = set(re.findall(r"\w+", work.pop()))
        found = (words & tables.keys()) - wanted
        wanted |= found
        work += [tables[name] for name in found]
    listed = ",\n".join(
        f"{name} AS {'MATERIALIZED ' if name in ONCE else ''}({tables[name]})" for name in order if name in wanted
    )
    return f"WITH RECURSIVE {listed}\n{body}" if listed else body


def vector(x: str, names: list[str]) -> str:
    return commas(r(f"{x}[{i + 1}]", n) for i, n in enumerate(names))


ES = [f"e{i}" for i in range(D)]
MEAN = commas(f"avg(v.embedding[{i + 1}]::DOUBLE) AS e{i}" for i in range(D))
MEANS = commas(r(e, e) for e in ES)

TREE_MEANS = f"""SELECT a.message_id, {MEAN} FROM vectors a JOIN tree_pairs p ON p.anchor = a.message_id
  JOIN vectors v ON v.message_id = p.member AND v.author = a.author GROUP BY a.message_id"""
BRANCH_MEANS = f"""SELECT a.message_id, {MEAN} FROM vectors a JOIN closure p ON p.anchor = a.message_id
  JOIN vectors v ON v.message_id = p.member AND v.author = a.author GROUP BY a.message_id"""
FIT_MEANS = f"""SELECT x.fit, v.author, {MEAN} FROM rows_ x JOIN vectors v USING (message_id)
  WHERE x.split = 'train' AND v.author IS NOT NULL GROUP BY x.fit, v.author"""
FIT_DEFAULT = f"SELECT fit, {commas(f'avg({e}) AS {e}' for e in ES)} FROM fit_means GROUP BY fit"

EMBEDDING_CTES = [
    ("fit_means", FIT_MEANS),
    ("fit_mean_default", FIT_DEFAULT),
    ("tree_means", TREE_MEANS),
    ("branch_means", BRANCH_MEANS),
    ("x", f"""SELECT w.fit, w.split, w.message_id, w.parent,
    {commas(f'coalesce(m.{e}, d.{e})::FLOAT::DOUBLE AS forum_{e}' for e in ES)},
    {commas(f't.{e}::FLOAT::DOUBLE AS tree_{e}' for e in ES)},
    {commas(f'b.{e}::FLOAT::DOUBLE AS branch_{e}' for e in ES)}
    FROM rows_ w LEFT JOIN fit_means m ON m.fit = w.fit AND m.author = w.author
    JOIN fit_mean_default d ON d.fit = w.fit
    JOIN tree_means t ON t.message_id = w.message_id JOIN branch_means b ON b.message_id = w.message_id"""),
]
XS = [f"{level}_{e}" for level in ("forum", "tree", "branch") for e in ES]

BEHAVIOUR = f"""FROM rows_ w LEFT JOIN fit_forum f ON f.fit = w.fit AND f.author = w.author
  JOIN fit_forum_default d ON d.fit = w.fit
  LEFT JOIN fit_tree t ON t.fit = w.fit AND t.message_id = w.message_id
  LEFT JOIN fit_branch b ON b.fit = w.fit AND b.message_id = w.message_id"""
BEHAVIOUR_COLUMNS = commas(
    [flat("f.", "_forum", True, "d."), flat("t.", "_tree", True, "d."), flat("b.", "_branch", True, "d.")]
)
LAST_USER = f"""SELECT w.fit, w.split, w.message_id, coalesce(p.message_id, -1) AS last_user FROM rows_ w
  LEFT JOIN rows_ p ON p.fit = w.fit AND p.split = w.split AND p.message_id = w.parent"""


def context_query(pairs: str, name: str) -> str:
    extremes = commas(
        f"{side}({c}) FILTER (WHERE author <> anchor_author) AS {'lo' if side == 'min' else 'hi'}_{c}"
        for c in SCALED for side in ("min", "max")
    )
    shown = commas(r(f"{s}_{c}", f"{s}_{c}") for c in SCALED for s in ("lo", "hi"))
    return f"""SELECT o.anchor AS message_id, o.anchor_author AS author, n.context_size,
        o.own_messages, o.own_first_ts, {shown}
      FROM (SELECT anchor, anchor_author,
          max(num_comment) FILTER (WHERE author = anchor_author)::BIGINT AS own_messages,
          max(min_ts) FILTER (WHERE author = anchor_author) AS own_first_ts, {extremes}
        FROM {name}_c GROUP BY anchor, anchor_author) o
      JOIN (SELECT anchor, count(*) AS context_size FROM {pairs} GROUP BY anchor) n ON n.anchor = o.anchor"""


def leaf_query(rows: str) -> str:
    return f"""SELECT message_id, tree_id, parent FROM {rows} m
      ANTI JOIN (SELECT DISTINCT parent AS message_id FROM {rows}) c USING (message_id)"""


def path_query(rows: str, closure: str) -> str:
    return f"""SELECT anchor AS leaf_id, steps AS up_steps, member AS message_id FROM {closure}
      WHERE anchor NOT IN (SELECT parent FROM {rows})"""


FORUM_RAW = f"""SELECT author, {commas(r(minmax(c, f'min({c}) OVER ()', f'max({c}) OVER ()'), c) for c in SCALED)}
  FROM forum_b"""

# every method with every pair of encoders; two methods do not look at the user's, and get the first
GRID = """SELECT DISTINCT method || '_' || c || CASE WHEN alone THEN '' ELSE '_' || u END AS config, method,
    c AS current, CASE WHEN alone THEN 'stored' ELSE u END AS "user"
  FROM (VALUES ('one_hot_vector', true), ('behaviour', true), ('embedding', false), ('combined', false)) AS m(method, alone)
  CROSS JOIN (VALUES ('stored'), ('hashed')) AS a(c) CROSS JOIN (VALUES ('stored'), ('hashed')) AS b(u)"""

ORACLES = {
    "scan_messages": sql("SELECT message_id, node_id, tree_id, parent, author, ts, md5(text) AS text_md5 FROM msgs"),
    "scan_csv": sql(f"""SELECT message_id, tree_id::VARCHAR AS tree_id, parent, author, ts, md5(text) AS text_md5,
        {commas(f'tags[{i + 1}] AS {q(t)}' for i, t in enumerate(TAGS))} FROM msgs"""),
    "csv_tree_profile": sql(f"SELECT message_id, author, {flat()} FROM tree"),
    "ingest_faults": sql("""SELECT (SELECT count(*) FROM hurt) AS rows, (SELECT count(*) FROM hurt WHERE message_id IS NULL) AS no_id,
        (SELECT count(*) FROM (SELECT message_id FROM hurt WHERE message_id IS NOT NULL GROUP BY message_id HAVING count(*) > 1)) AS repeated_ids,
        (SELECT count(*) FROM hurt WHERE parent IS NULL) AS no_parent,
        (SELECT count(*) FROM hurt c WHERE parent <> -1 AND NOT EXISTS (SELECT 1 FROM hurt p WHERE p.message_id = c.parent)) AS lost_parents,
        (SELECT count(*) FROM hurt c WHERE parent <> -1 AND EXISTS (SELECT 1 FROM hurt p WHERE p.message_id = c.parent)
          AND NOT EXISTS (SELECT 1 FROM hurt p WHERE p.message_id = c.parent AND p.tree_id = c.tree_id)) AS foreign_parents""", [
        ("hurt", """SELECT CASE WHEN message_id % 23 <> 0 THEN message_id END AS message_id,
            tree_id + (message_id % 19 = 0)::INTEGER AS tree_id, CASE WHEN message_id % 17 <> 0 THEN parent END AS parent,
            unnest(CASE WHEN message_id % 13 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM msgs WHERE message_id % 11 <> 0"""),
    ]),
    "word_count": sql("SELECT doc_id, words AS word_count FROM docs"),
    "untagged_flag": sql(f"SELECT message_id, tags[{N}] AS untagged FROM msgs"),
    "label_matrix": sql(f"SELECT message_id, {commas(f'tags[{i + 1}] AS {q(t)}' for i, t in enumerate(TAGS))} FROM msgs"),
    "labels_long": sql("SELECT message_id, tag_pos, y FROM long"),
    "tag_category": sql("SELECT message_id, tag_pos, tag, category FROM long JOIN cats USING (tag_pos) WHERE y = 1"),
    "thread_members": sql("""SELECT tree_id, row_number() OVER (PARTITION BY tree_id ORDER BY message_id) - 1 AS member_pos,
        message_id FROM msgs"""),
    "thread_leaves": sql(leaf_query("msgs")),
    "thread_shape": sql("""SELECT d.message_id, d.depth, s.subtree_size FROM
        (SELECT anchor AS message_id, max(steps) AS depth FROM closure GROUP BY anchor) d JOIN
        (SELECT member AS message_id, count(*) AS subtree_size FROM closure GROUP BY member) s USING (message_id)"""),
    "root_paths": sql(path_query("msgs", "closure")),
    "conversation_paths": sql(path_query("convs", "conv_closure")),
    "conversation_leaves": sql(leaf_query("convs")),
    "row_positions": sql("SELECT message_id, row_number() OVER (ORDER BY message_id) - 1 AS position FROM msgs"),
    "context_tree": sql(context_query("tree_pairs", "tree")),
    "context_branch": sql(context_query("closure", "branch")),
    "running_activity": sql("""SELECT message_id, count(*) OVER w AS num_comment, min(ts) OVER w AS first_ts,
        max(ts) OVER w AS last_ts FROM msgs
        WINDOW w AS (PARTITION BY tree_id, author ORDER BY message_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    "group_kfold": sql("SELECT tree_id, thread_size, fold FROM folds"),
    "fold_split_sizes": sql("SELECT fit, split, count(*) AS messages FROM rows_ GROUP BY fit, split"),
    "train_test_union": sql("SELECT fit, split, message_id FROM rows_"),
    "unseen_authors": sql("""SELECT DISTINCT fit, author FROM rows_ t WHERE split = 'test' AND author IS NOT NULL AND NOT EXISTS
        (SELECT 1 FROM rows_ s WHERE s.split = 'train' AND s.fit = t.fit AND s.author = t.author)"""),
    "returning_authors": sql("""SELECT DISTINCT fit, author FROM rows_ t WHERE split = 'test' AND EXISTS
        (SELECT 1 FROM rows_ s WHERE s.split = 'train' AND s.fit = t.fit AND s.author = t.author)"""),
    "author_word_avg": sql(f"SELECT author, {r('avg(words)', 'avg_word_text')} FROM msgs WHERE author IS NOT NULL GROUP BY author"),
    "author_activity": sql(f"""SELECT author, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS num_comment,
        {r('(max(ts) - min(ts)) / count(*)', 'sending_rate')} FROM msgs WHERE author IS NOT NULL GROUP BY author"""),
    "author_tag_sums": sql(f"""SELECT author, {commas(f'sum(tags[{i + 1}])::BIGINT AS {q(t)}' for i, t in enumerate(TAGS))}
        FROM msgs WHERE author IS NOT NULL GROUP BY author"""),
    "author_diversity": sql(f"SELECT author, {r('diversity', 'diversity')}, {r('avg_tag_msg', 'avg_tag_msg')} FROM forum_b"),
    "minmax_columns": sql(FORUM_RAW),
    "minmax_tags_sequential": sql(f"SELECT author, {commas(r(f'tags[{i + 1}]', q(t)) for i, t in enumerate(TAGS))} FROM forum"),
    "forum_profile": sql(f"SELECT author, {flat()} FROM forum"),
    "default_profile": sql(f"SELECT fit, {flat()} FROM fit_forum_default"),
    "tag_history_fallback": sql(f"""SELECT anchor AS message_id, {commas(r(f'sums[{i + 1}]', q(t)) for i, t in enumerate(TAGS))}
        FROM tree_b WHERE author = anchor_author"""),
    "tag_history_loo": sql(f"""SELECT fit, anchor AS message_id,
        {commas(r(f'coalesce(sums[{i + 1}], 0)', q(t)) for i, t in enumerate(TAGS))} FROM loo"""),
    "tree_profile": sql(f"SELECT message_id, author, {flat()} FROM tree"),
    "branch_profile": sql(f"SELECT message_id, author, {flat()} FROM branch"),
    "profiles_for_fold": sql(f"""SELECT fit, 'tree' AS level, message_id, {flat()} FROM fit_tree
        UNION ALL SELECT fit, 'branch', message_id, {flat()} FROM fit_branch"""),
    "author_mean_embedding": sql(f"SELECT author, {MEANS} FROM (SELECT v.author, {MEAN} FROM vectors v WHERE v.author IS NOT NULL GROUP BY v.author)"),
    "emb_forum": sql(f"""SELECT a.message_id, {MEANS} FROM vectors a LEFT JOIN
        (SELECT v.author, {MEAN} FROM vectors v GROUP BY v.author) m USING (author)"""),
    "emb_tree": sql(f"SELECT message_id, {MEANS} FROM ({TREE_MEANS})"),
    "emb_branch": sql(f"SELECT message_id, {MEANS} FROM ({BRANCH_MEANS})"),
    "embed_text_hashed": sql(f"""SELECT doc_id, bucket, {r('n / sqrt(sum(n * n) OVER (PARTITION BY doc_id))', 'value')} FROM (
        SELECT doc_id, (('0x' || substr(md5(token), 1, 4))::INTEGER % {D})::INTEGER AS bucket, count(*)::DOUBLE AS n
        FROM (SELECT doc_id, unnest({WORDS}) AS token FROM documents) GROUP BY 1, 2)"""),
    "embed_text_model": f"""SELECT doc_id, {commas(f32(f'n[{i + 1}] / greatest(list_sum(n), 1)', f'e{i}') for i in range(8))} FROM (
        SELECT doc_id, [{commas(f'len(list_filter(points, lambda p: p % 8 = {i}))::DOUBLE' for i in range(8))}] AS n FROM (
          SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '(?s).'), lambda c: unicode(c)) AS points FROM documents))""",
    "forum_attach_train": sql(f"""SELECT w.fit, w.message_id, {flat('f.', '', True, 'd.')} FROM rows_ w
        LEFT JOIN fit_forum f ON f.fit = w.fit AND f.author = w.author JOIN fit_forum_default d ON d.fit = w.fit
        WHERE w.split = 'train'"""),
    "forum_attach_test": sql(f"""SELECT w.fit, w.message_id, {flat('f.', '', True, 'd.')} FROM rows_ w
        LEFT JOIN fit_forum f ON f.fit = w.fit AND f.author = w.author JOIN fit_forum_default d ON d.fit = w.fit
        WHERE w.split = 'test'"""),
    "design_behaviour": sql(f"SELECT w.fit, w.split, w.message_id, {BEHAVIOUR_COLUMNS} {BEHAVIOUR}"),
    "design_embedding": sql(f"SELECT fit, split, message_id, {commas(r(c, c) for c in XS)} FROM x", EMBEDDING_CTES),
    "design_combined": sql(f"""SELECT w.fit, w.split, w.message_id, {BEHAVIOUR_COLUMNS},
        {commas(r(f'x.{c}', c) for c in XS)} {BEHAVIOUR}
        JOIN x ON x.fit = w.fit AND x.message_id = w.message_id""", EMBEDDING_CTES),
    "default_vector": sql(f"""SELECT d.fit, {commas(flat('d.', f'_{level}', True) for level in ('forum', 'tree', 'branch'))},
        {commas(f32(f'm.{e}', f'{level}_{e}') for level in ('forum', 'tree', 'branch') for e in ES)}
        FROM fit_forum_default d JOIN fit_mean_default m USING (fit)""", EMBEDDING_CTES),
    "last_user": sql(LAST_USER),
    "last_user_features": sql(f"""SELECT l.fit, l.split, l.message_id,
        {commas(f'CASE WHEN l.last_user = -1 THEN y.{q(n)} ELSE x.{q(n)} END AS {q(n)}' for n in behaviour_names(TAGS))}
        FROM ({LAST_USER}) l
        LEFT JOIN (SELECT w.fit, w.message_id, {BEHAVIOUR_COLUMNS} {BEHAVIOUR}) x ON x.fit = l.fit AND x.message_id = l.last_user
        JOIN (SELECT d.fit, {commas(flat('d.', f'_{level}', True) for level in ('forum', 'tree', 'branch'))} FROM fit_forum_default d) y
          ON y.fit = l.fit"""),
    "model_inputs": sql(f"""SELECT x.fit, x.split, x.message_id,
        {commas(f32(f'v.embedding[{i + 1}]', f'now_e{i}') for i in range(D))},
        {commas(r(f'x.{c}', c) for c in XS)},
        {commas(r(f'CASE WHEN l.last_user = -1 THEN d.{c.split("_")[1]}::FLOAT::DOUBLE ELSE p.{c} END', f'last_{c}') for c in XS)}
        FROM x JOIN ({LAST_USER}) l ON l.fit = x.fit AND l.message_id = x.message_id
        LEFT JOIN x p ON p.fit = l.fit AND p.message_id = l.last_user
        JOIN fit_mean_default d ON d.fit = x.fit JOIN vectors v ON v.message_id = x.message_id""", EMBEDDING_CTES),
    "author_one_hot": sql("""SELECT message_id, author_idx FROM msgs JOIN (SELECT author,
        row_number() OVER (ORDER BY author) - 1 AS author_idx FROM (SELECT DISTINCT author FROM msgs WHERE author IS NOT NULL)) USING (author)"""),
    "feature_store_resume": sql(f"SELECT fit, split, message_id, {commas(r(c, c) for c in XS)} FROM x", EMBEDDING_CTES),
    "feature_store_roundtrip": sql(f"SELECT fit AS fold, author, {flat()} FROM fit_forum"),
    "binarize_scores": sql("SELECT message_id, tag_pos, (p > 0.5)::INTEGER AS predicted FROM long"),
    "tag_support": sql("SELECT tag_pos, sum(y)::BIGINT AS support FROM long GROUP BY tag_pos"),
    "tag_prf": sql(f"SELECT fold, tag_pos, {r('precision', 'precision')}, {r('recall', 'recall')}, {r('f1', 'f1')}, support FROM prf"),
    "tag_weights": sql(f"SELECT fold, tag, category, support, category_support, {r('weight', 'weight')} FROM weights"),
    "overall_f1": sql(f"SELECT fold, {r('macro_f1', 'macro_f1')}, {r('weighted_f1', 'weighted_f1')} FROM f1s"),
    "category_f1": sql(f"SELECT category, {commas(r(c, c) for c in ('macro_f1', 'weighted_mean', 'weighted_sum'))} FROM cat_f1"),
    "fold_average": sql(f"""SELECT {commas(r(f'avg({c})', c) for c in ('loss', 'accuracy', 'macro_f1', 'weighted_f1'))}
        FROM f1s JOIN loss USING (fold) JOIN accuracy USING (fold)"""),
    "bce_loss": sql(f"SELECT fold, {r('loss', 'loss')} FROM loss"),
    "argmax_accuracy": sql(f"SELECT fold, {r('accuracy', 'accuracy')} FROM accuracy"),
    "binary_accuracy": sql(f"SELECT fold, {r('avg(((p > 0.5)::INTEGER = y)::INTEGER)', 'binary_accuracy')} FROM long GROUP BY fold"),
    "results_json": sql(f"SELECT 'scores' AS config, 'BCE' AS loss, metric, {r('value', 'value')} FROM results"),
    "metric_report": sql("SELECT metric, printf('%s: %.4f', metric, value) AS line FROM results"),
    "results_nested": sql("""SELECT 'scores' AS config, 'BCE' AS loss, metric, round(value, 6) + 0.0 AS value FROM results"""),
    "experiment_grid": sql(f"""SELECT g.*, s.fit, s.split, s.messages FROM ({GRID}) g
        CROSS JOIN (SELECT fit, split, count(*) AS messages FROM rows_ GROUP BY fit, split) s"""),
    "gradient_step": sql(f"""SELECT m.fit, m.input, s.tag_pos, {r('share * mean - coalesce(xy, 0) / n', 'gradient')}
        FROM input_means m JOIN tag_shares s ON s.fit = m.fit
        LEFT JOIN products p ON p.fit = m.fit AND p.input = m.input AND p.tag_pos = s.tag_pos""", [
        ("cells", f"""SELECT w.fit, w.message_id, u.input, u.x FROM rows_ w JOIN vectors v USING (message_id),
          LATERAL (SELECT unnest(range(0, {D} + 1))::INTEGER AS input, unnest(list_concat(v.embedding, [1.0]))::FLOAT::DOUBLE AS x) u
          WHERE w.split = 'train'"""),
        ("input_means", "SELECT fit, input, avg(x) AS mean, count(*) AS n FROM cells GROUP BY fit, input"),
        ("tagged", f"SELECT fit, message_id, unnest(range(0, {N}))::INTEGER AS tag_pos, unnest(tags) AS y FROM rows_ WHERE split = 'train'"),
        ("tag_shares", "SELECT fit, tag_pos, avg(y) AS share FROM tagged GROUP BY fit, tag_pos"),
        ("products", """SELECT c.fit, c.input, t.tag_pos, sum(c.x) AS xy FROM cells c JOIN tagged t
          ON t.fit = c.fit AND t.message_id = c.message_id AND t.y = 1 GROUP BY c.fit, c.input, t.tag_pos"""),
    ]),
    "score_fixed_weights": sql(f"""SELECT message_id, fit AS fold, tag_pos, y, {r('1 / (1 + exp(-z))', 'p')} FROM (
          SELECT w.message_id, w.fit, c.tag_pos, any_value(w.tags[c.tag_pos + 1])::INTEGER AS y,
            sum(u.x * ((u.input * 7 + c.tag_pos * 3 + w.fit) % 11 - 5) / 10.0) AS z
          FROM rows_ w JOIN vectors v USING (message_id),
          LATERAL (SELECT unnest(range(0, {D} + 1))::INTEGER AS input, unnest(list_concat(v.embedding, [1.0]))::FLOAT::DOUBLE AS x) u,
          (SELECT unnest(range(0, {N}))::INTEGER AS tag_pos) c WHERE w.split = 'test'
          GROUP BY w.message_id, w.fit, c.tag_pos)"""),
}
