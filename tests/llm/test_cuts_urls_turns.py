"""Fill-in-the-middle, URL trust and turn repair on small inputs, against plain models."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import fill_in_middle, queries, sql_twins, turn_repair, url_trust

# -- fill-in-the-middle

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain_fim(doc_id, text):
    """By the words of the contract, unit by unit."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(n, seed=1):
    r = random.Random(seed)
    parts = ["a", "Zed", "é", "中", " ", "12", "😀", "\n", "<", "<S", "P>", ">", "ß", "`", "{", "[", "@"]
    return ["".join(r.choice(parts) for _ in range(r.choice([0, 1, 2, 9, 60]))) for _ in range(n)]


@pytest.mark.parametrize("block, group", [(1, 1), (3, 64), (7, 4 << 20), (1 << 20, 4 << 20)])
def test_cut_places(monkeypatch, block, group):
    monkeypatch.setattr(fill_in_middle, "_BLOCK", block)
    monkeypatch.setattr(fill_in_middle, "_GROUP", group)
    r, ts = random.Random(2), texts(300)
    a, b = (np.array([r.randrange(2**32) for _ in ts]) for _ in range(2))
    n, first, second = fill_in_middle.cut_places(pa.array(["before", *ts])[1:], a, b)
    for i, t in enumerate(ts):
        units = UNIT.findall(t)
        x, y = sorted((a[i] % (len(units) + 1), b[i] % (len(units) + 1)))
        assert (n[i], first[i], second[i]) == (len(units), len("".join(units[:x])), len("".join(units[:y])))
    assert [len(x) for x in fill_in_middle.cut_places(pa.array([], pa.string()), a[:0], b[:0])] == [0, 0, 0]


def test_fill_in_middle(spark):
    rows = list(enumerate(texts(400))) + [(1000, None), (1001, ""), (1002, "one <P> two"), (1003, "<M>"), (1004, "word " * 200000), (1005, "x" * 300000), (None, "no id"), (None, None), (7, "a b"), (7, "a b"), (-3, "minus")]
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n int, _h string, form string")
    out = fill_in_middle.fill_in_middle(docs)
    got = sorted(map(repr, (tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect())))
    assert got == sorted(repr(plain_fim(*r)) for r in rows)
    assert out.filter(fill_in_middle.restored() != out.text).count() == 0
    assert {r.form for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


# -- url trust

PAGES = [
    (1, "https://good.example.org/en/2", '<a href="https://friend.net/x">f</a><A class=q HREF=//Both.net>b</A><a href="/own">o</a>'),
    (2, "https://good.example.org/en/3", "<a href='http://friend.net?x'>f</a><a href='http://good.example.org/'>self</a>"),
    (3, "http://bad.com/de/1", '<a href="http://victim.net">v</a>'),
    (4, "http://bad.com/de/2?x://y", None),
    (5, "http://farm.net/", '<a title="<" href="http://bad.com/"></a><a href="http://bad.com/">b</a><b href="http://friend.net/">no link</b>'),
    (6, "http://farm.net/2", '<a href="HTTPS://bad.com"></a>'),
    (7, "http://friend.net/en", '<a href="http://victim.net">x</a>'),
    (8, "http://victim.net/de/", ""),
    (9, "http://both.net", '<a href="http://bad.com">b</a>'),
    (10, "HTTP://WWW.Example.ORG/es/x#y", ""), (11, "http://example.org/en/1", ""), (12, "http://example.org/en/12", ""), (13, "http://xexample.org/es/", ""), (14, "http://org/", ""),
    (15, "http://org?x", ""), (16, None, None), (17, "no scheme.org/", '<a href="http://bad.com">b</a>'), (18, "", ""), (19, "://", ""), (20, "ftp://a.com/fr/", ""), (21, "http://a.com:80/fr/", ""),
    (22, "http://half.com/de/", ""), (22, "http://half.com/de/", ""), (23, "http://half.com/fr/", ""), (24, "http://half.com/en/", ""), (25, "http://bad.com/en/", ""), (None, "http://friend.net/en", ""),
]


def plain_trust(pages):
    """Scores by rounds over dictionaries."""
    tag = re.compile(r"<a\s[^<>]*?href\s*=\s*[\"']?\s*(?:[a-z]+:)?//([^/?#\"'\s<>]*)", re.I)
    rules = sql_twins.URL_RULES
    parsed, links, seen = [], {}, {}
    for k, url, html in pages:
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit)[2:] if fit else (None, None)
        parsed.append((k, host, path, rule, verdict))
        if host:
            s = seen.setdefault(host, [0, 0, 0])
            s[0] += 1
            s[1] += verdict == "allow"
            s[2] += verdict == "block"
            for t in {m.lower() for m in tag.findall(html or "")} - {host, ""}:
                links[host, t] = links.get((host, t), 0) + 1
    score = {}
    for kind in (1, 2):
        edges = {}
        for (a, b), n in links.items():
            a, b = (a, b) if kind == 1 else (b, a)
            edges.setdefault(a, {})[b] = n
        push = {h: s[kind] * url_trust.UNIT // s[0] * 15 // 100 for h, s in seen.items() if s[kind]}
        total = {}
        while push:
            nxt = {}
            for h, v in push.items():
                total[h] = total.get(h, 0) + v
                if v >= url_trust.LEAST_PUSH:
                    for t, n in edges.get(h, {}).items():
                        share = v // sum(edges[h].values()) * n // 100 * 85
                        if share:
                            nxt[t] = nxt.get(t, 0) + share
            push = nxt
        score[kind] = total
    out = []
    for k, host, path, rule, verdict in parsed:
        trust, distrust = score[1].get(host, 0), score[2].get(host, 0)
        out.append((k, host, path, rule, verdict or ("block" if distrust - trust > url_trust.MARGIN else "allow"), trust, distrust))
    return sorted(out, key=repr)


def test_judge_urls(spark):
    pages = spark.createDataFrame([(k, u, h, "x", "y", 1) for k, u, h in PAGES], "page_id long, url string, html string, host string, rule string, n int")
    got = sorted((tuple(r) for r in url_trust.judge_urls(pages, sql_twins.URL_RULES).collect()), key=repr)
    assert got == plain_trust(PAGES)
    verdict = {r[0]: r[4] for r in got}
    assert verdict[5] == verdict[6] == "block"  # links to a blocked host alone
    assert verdict[8] == "allow" and verdict[7] == "allow" and verdict[25] == "block" and verdict[24] == "allow"
    assert [r[3] for r in got if r[0] in (10, 11, 12, 13, 14, 15)] == ["example.org/es/", "example.org/en/1", "example.org/en/1", "org/", "org/", None]
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", PAGES)
    cur = con.execute(sql_twins.URL_TRUST)
    order = [[d[0] for d in cur.description].index(c) for c in ("page_id", "host", "path", "rule", "verdict", "trust", "distrust")]
    assert sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr) == got


def test_judge_urls_by_a_table_of_rules(spark):
    pages = spark.createDataFrame([(k, u, h) for k, u, h in PAGES], "page_id long, url string, html string")
    rules = spark.createDataFrame([("FRIEND.net", "", "block"), ("net", "/", "allow"), ("friend.net", "", "allow")], "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_trust.judge_urls(pages, rules).collect()}
    assert got[7] == ("friend.net", "block") and got[8] == ("net/", "allow") and got[1][0] is None
    assert {r.rule for r in url_trust.judge_urls(pages, []).collect()} == {None}
    assert url_trust.judge_urls(pages.limit(0), rules).count() == 0


# -- turn repair

RIGHT = re.compile("(s?(ua)+)?")


def brute_repairs(rows):
    """The cheapest edits by trying all that cost no more than deleting everything."""
    best = [(4 * len(rows), "D" * len(rows))]

    def go(i, cost, audit, initials):
        if (cost, "") > best[0]:
            return
        if i == len(rows) and RIGHT.fullmatch(initials):
            best[0] = min(best[0], (cost, audit))
        for new in "ua":
            go(i, cost + 3, audit + "I", initials + new)
        if i < len(rows):
            role, fault = rows[i]
            go(i + 1, cost + 4, audit + "D", initials)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                go(i + 1, cost + more, audit + "K", initials + role)
                for new in "ua":
                    go(i + 1, cost + 3 + more, audit + "R", initials + new)

    go(0, 0, "", "")
    return best[0]


def some_rows(r, n):
    return [(r.choice("suaaux"), r.choice([None, None, "blank", "duplicate", "truncated"])) for _ in range(n)]


def test_cheapest_is_that_of_brute_force():
    r = random.Random(5)
    for n in [0, 1, 1, 2, 2, 2, 3, 3, 3] * 12 + [4] * 20:
        rows = some_rows(r, n)
        assert turn_repair.cheapest("".join(turn_repair.letter(*x) for x in rows)) == brute_repairs(rows), rows


def test_pieces_join_to_the_whole():
    r = random.Random(6)
    for _ in range(150):
        rows = "".join(turn_repair.letter(*x) for x in some_rows(r, r.randint(1, 60)))
        joined, cut, got = turn_repair.Joined(), sorted({0, len(rows), *[r.randrange(len(rows)) for _ in range(r.randint(0, 9))]}), []
        for a, b in zip(cut, cut[1:]):
            got += joined.add(rows[a:b], turn_repair.crossings(rows[a:b]))
        got += joined.close()
        assert [g[0] for g in got] == [rows[a:b] for a, b in zip(cut, cut[1:])]
        assert "".join(g[2] for g in got) == turn_repair.cheapest(rows)[1]
        state = turn_repair.START
        for piece, entry, edits in got:
            assert entry == state
            state = turn_repair.applied(piece, edits, entry)[1]
        assert state in (turn_repair.START, turn_repair.ASSISTANT)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role or " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain_report(rows, repairs):
    """conv_id to its result; rows of equal turn are only compared where they are equal."""
    groups = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in plain_damage(rows):
        groups[conv].append((turn is not None, turn or 0, role, text))
    out = set()
    for conv, group in groups.items():
        group.sort()
        seen, faults, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in group:
            body = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            if fault:
                counts[fault] += 1
        turns = [t for known, t, *_ in group if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [g[2][:1] for g in group]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        cost, audit = repairs(list(zip([x or "-" for x in initials], faults)))  # no letter, so not to be kept
        lines, i, spelled = [], 0, ""
        left = len(audit) - audit.count("D")
        for e in audit:
            want = ("s" + "ua" * left)[len(spelled)] if left % 2 else ("ua" * left)[len(spelled) : len(spelled) + 1]
            if e != "D":
                _, _, role, text = group[i] if e != "I" else (0, 0, "", "")
                role = role if e == "K" else {"u": "user", "a": "assistant"}[want]
                spelled += role[0]
                lines.append(f"{role}:{text}")
            i += e != "I"
        assert RIGHT.fullmatch(spelled)
        out.add((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def report_of(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "conv_id long, turn long, role string, text string, seq string, fault string, position int")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_turn_repair(spark, str(tmp_path)).collect()
    assert len(got) == len({r[0] for r in rows})
    return {tuple(r) for r in got}


def test_turn_repair(spark, tmp_path):
    r = random.Random(7)
    says = ["yes.", "yes.", "no", "Why?", " ", "", None, "a\nb!", "tail \t\n", "end. \n", "x" * 50000 + ".", "é。"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "user", "assistant", "tool", None]), r.choice(says)) for c in range(60) for t in r.sample(range(9), r.randint(1, 4))]
    rows += [(100, None, "user", "a."), (101, None, "user", "x."), (101, 5, "assistant", "y."), (101, 9, "user", "z"), (None, 1, "user", "q."), (None, 2, "assistant", "r."), (None, None, None, None)]
    rows += [(102, 1, "user", "same."), (102, 1, "user", "same."), (102, 1, "user", "same."), (103, 3, "", "no role.")]
    assert report_of(spark, tmp_path, rows) == plain_report(rows, brute_repairs)


def test_a_long_conversation_in_many_pieces(spark, tmp_path):
    r = random.Random(8)
    roles = ["user", "assistant", "user", "assistant", "system"]
    rows = [(1, t, r.choice(roles), r.choice(["yes.", "no", ""]) if t % 7 == 0 else f"text {t}.") for t in range(2600)] + [(c, t, "user", f"{c} {t}.") for c in (0, 2, 3) for t in range(3)]
    rows += [(4, t // 5, "user", "all the same.") for t in range(700)]
    whole = lambda rows: turn_repair.cheapest("".join(turn_repair.letter(*x) for x in rows))
    assert report_of(spark, tmp_path, rows) == plain_report(rows, whole)


def test_turn_repair_without_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    repair = turn_repair.repair_turns(turn_repair.damaged(none))
    assert repair.report.count() == repair.turns.count() == turn_repair.conversation_digests(repair.turns).count() == 0
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    repair = turn_repair.repair_turns(turn_repair.damaged(spark.createDataFrame([(lost, 0, "user", "x.")], none.schema)))
    assert repair.report.count() == 0
