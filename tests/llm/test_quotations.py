"""Quotation linking against plain Python."""

import re
from collections import Counter, defaultdict

import pytest

from daymart.llm.quotations import format_chats

SCHEMA = "conv_id long, turn int, role string, text string, c string, t long, own string, level int"

DATA = [
    (1, 0, "user", "Hello  there\n\nSecond paragraph here"),
    (1, 1, "assistant", "> hello there\n\nHi!\nHow are you?"),
    (1, 2, "user", "Ann wrote:\n>> Hello there\n> hi!\n> How are you?\nFine, thanks"),
    (1, 3, "user", "New topic"),
    (1, 4, "assistant", "> > hi!\n> Fine, thanks\nGood"),
    (1, 5, "assistant", "> nowhere said\nok"),
    (1, 6, "user", "> good\n> \n> something else\nyes\nAnn wrote: this"),
    (2, 0, "user", "> New topic\nsay more"),
    (2, 1, "user", "say more"),
    (2, 2, "user", "> SAY MORE\nagain"),
    (2, 2, "user", "> SAY MORE\nagain"),
    (2, 3, None, None),
    (2, 4, "user", ""),
    (2, None, "user", "> again\nlost turn"),
    (None, 1, "user", "alone"),
    (None, 2, "user", "> alone\nanswer"),
    (3, 0, "user", "> "),
    (3, 1, "user", ">\t>deep\n"),
    (4, 0, "user", "x\n" * 3000 + "end"),
    (4, 1, "user", "".join(f"> q{i}\n\n" for i in range(300)) + "> end\nlast"),
]


def norm(s):
    return re.sub(r"\s+", " ", s.lower()).strip(" ")


def parse(text):
    out = []
    for line in re.split(r"\r?\n", text):
        marks = re.match(r"(?:[ \t]*>)+", line)
        out.append((marks[0].count(">") if marks else 0, line[len(marks[0]) :] if marks else line, line))
    return out


def brute(data):
    own, quotes = [], []
    for conv, turn, role, text in data:
        lines = parse(text or "")
        if any(x[0] for x in lines):
            keep = [x[2] for i, x in enumerate(lines) if x[0] == 0 and not (i + 1 < len(lines) and lines[i + 1][0] and re.search(r"wrote\s*:\s*$", x[2]))]
            own.append(re.sub(r"^\s*\n|\s+$", "", "\n".join(keep)))
        else:
            own.append(text or "")
        runs, before = [], 0
        for level, body, _ in lines:
            if level and level == before:
                runs[-1][1].append(body.strip(" "))
            elif level:
                runs.append((level, [body.strip(" ")]))
            before = level
        found = []
        for level, body in runs:
            whole = "\n".join(body)
            keys = list(dict.fromkeys(k for k in map(norm, [whole, *re.split(r"\n\n+", whole)]) if k))
            if keys:
                found.append((level, keys))
        quotes.append(found)
    has = defaultdict(set)
    for (conv, turn, _, _), text in zip(data, own):
        for p in [text, *re.split(r"\n[ \t]*\n", text), *text.split("\n")]:
            if norm(p):
                has[norm(p)].add((conv, -1 if turn is None else turn))
    up, rows = {}, []
    for (conv, turn, role, _), text, found in zip(data, own, quotes):
        t = -1 if turn is None else turn
        best, far = None, None
        for level, keys in found:
            near = next((max(x[1] for x in has[k] if x[0] == conv and x[1] < t) for k in keys if any(x[0] == conv and x[1] < t for x in has[k])), None)
            if near is not None:
                best = min(best or (level, -near), (level, -near))
            else:
                order = lambda x: ("\0" if x[0] is None else str(x[0]), x[1])
                away = next((min(has[k], key=order) for k in keys if has[k] and min(has[k], key=order)[0] != conv), None)
                if away and (far is None or level < far[0]):
                    far = (level, away)
        reply = -best[1] if best else None
        if reply is not None:
            up[conv, t] = max(reply, up.get((conv, t), -9))
        rows.append([conv, turn, role, text, len(found), max([x[0] for x in found], default=0), reply, *((str(far[1][0]), far[1][1]) if far else (None, None)), t])
    for r in rows:
        while (r[0], r[9]) in up:
            r[9] = up[r[0], r[9]]
    return rows


@pytest.fixture(scope="module")
def result(spark):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in DATA], SCHEMA).repartition(5)
    return format_chats(df).collect()


def test_links(result):
    got = Counter(tuple(r[k] for k in "conv_id turn role text n_quotes levels reply_turn quoted_conv quoted_turn root_turn".split()) for r in result)
    want = Counter(map(tuple, brute(DATA)))
    assert got == want


def test_sql_says_the_same():
    import duckdb

    from daymart.llm.queries import SQL

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn INTEGER, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(d) for d in DATA])
    cur = con.execute(SQL["op3_chat_formatting"])
    names = [d[0] for d in cur.description]
    at = [names.index(k) for k in "conv_id turn role text n_quotes levels reply_turn quoted_conv quoted_turn root_turn".split()]
    assert Counter(tuple(r[i] for i in at) for r in cur.fetchall()) == Counter(map(tuple, brute(DATA)))


def test_order(result):
    by = defaultdict(list)
    for r in result:
        by[r.conv_id].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(len(rows)))
        keys = [(r.root_turn, -1 if r.turn is None else r.turn) for r in rows]
        assert keys == sorted(keys)
    assert [r.turn for r in by[1]] == [0, 1, 2, 4, 6, 3, 5]
    assert all(r.chat == f"<|{r.role or ''}|>\n{r.text}" for r in result)


def test_nothing(spark):
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


PARTS = [
    (1, 0, "user", "first line here\nsecond line here\nthird line here\n\nother paragraph"),
    (1, 1, "user", "One thing is this. Another thing is that! Is it all?"),
    (1, 2, "user", "Title\nThe sentence runs over\nthe line. Next one.\n\n一句话。第二句话。"),
    (1, 3, "user", "unrelated"),
    (1, 4, "assistant", "> first line here\n> second line here\na"),
    (1, 5, "assistant", "> Another thing is that!\nb"),
    (1, 6, "assistant", "> One thing is this. Another thing\n> is that!\nc"),
    (1, 7, "assistant", "> Next\n> one.\nd"),
    (1, 8, "assistant", "> 第二句话。\ne"),
    (1, 9, "assistant", "> nobody said this. Nor that.\nf"),
    (2, 0, "user", "Whole passage. Short."),
    (3, 0, "user", "Short."),
    (3, 1, "user", "> Whole passage. Short.\ng"),
]


def test_parts_of_passages(spark):
    """Quotations of some lines of a paragraph and of some sentences of a line or of wrapped lines."""
    data = PARTS
    rows = format_chats(spark.createDataFrame([(*r, "x", 1, "y", 2) for r in data], SCHEMA)).collect()
    got = {(r.conv_id, r.turn): (r.reply_turn, r.root_turn) for r in rows}
    assert [got[1, t][0] for t in range(4, 10)] == [0, 1, 1, 2, 2, None]
    assert [got[1, t][1] for t in range(4, 10)] == [0, 1, 1, 2, 2, 9]
    assert [r.turn for r in sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.position)] == [0, 4, 1, 5, 6, 2, 7, 8, 3, 9]
    # a whole passage elsewhere comes before a sentence of it in the conversation
    assert [(r.reply_turn, r.quoted_conv, r.quoted_turn) for r in rows if (r.conv_id, r.turn) == (3, 1)] == [(None, "2", 0)]


def test_sql_knows_parts_of_passages(spark):
    """Query and statement say the same of lines and sentences too."""
    import duckdb

    from daymart.llm.queries import SQL

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn INTEGER, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(d) for d in PARTS])
    cur = con.execute(SQL["op3_chat_formatting"])
    names = [d[0] for d in cur.description]
    rows = format_chats(spark.createDataFrame([(*r, "x", 1, "y", 2) for r in PARTS], SCHEMA)).collect()
    assert Counter(tuple(r[n] for n in names) for r in rows) == Counter(cur.fetchall())


def test_without_quotations_no_passage_is_cut(spark):
    from pyspark.sql import functions as F

    from daymart.llm import quotations

    rows = spark.createDataFrame([("1", i, 5, f"text {i}. more") for i in range(50)], "c string, t long, h long, text string").withColumn("own", F.col("text"))
    asked = spark.createDataFrame([], "k1 long, k2 long")
    assert quotations.passages_asked_for(rows, asked).collect() == []
