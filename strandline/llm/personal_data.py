"""Personal data: fixed patterns, then bootstrapped contextual extraction.

The fixed patterns give the base spans, and one more the secrets that are surely such:
lower-case hexadecimal values of 32 digits or more that are assigned to a credential's
name.  They are the seeds.  What stands round a seed, with digits as 0, makes lexical
patterns of its kind: the two and the three tokens before it, and one and two on each
side.  Patterns and the things they stand round make a graph, which is scored in
rounds:

* a pattern's confidence for a kind is the summed belief in the judged things of that
  kind that it stands round, over all judged things it stands round, plus one;
  judged are seeds, whose belief is 1, and the things that earlier rounds added;
* the belief in another thing is 1 - prod(1 - confidence) over its patterns that are
  more likely right than wrong (confidence of TRUST at least).

Patterns of SEEDS different judged things of a kind at least take part; a kind with
fewer seeds adds nothing.  Tokens with digits or an @ that no fixed pattern took,
neighbouring groups of digits as one, are further spans of a kind once they are believed
at BELIEF or more, and count as judged in the next rounds, which go on until one adds
nothing.  Everything between the one pass over the texts and the result is joins and sums
over mentions, whose number follows the seeds and such tokens.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import workspace

KINDS = ["email", "ip", "card", "phone"]
SECRET = len(KINDS)
ALL_KINDS = [*KINDS, "secret"]  # the last has no base spans: the method adds all of them
SEEDS, BELIEF, TRUST = 5, 0.8, 0.5
CONTEXT_CHARS = 120
START, END = "\x02", "\x03"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive runs from the first digit of a run find the same matches as the plain
# forms, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"""(?:token|secret|passw(?:or)?d|(?:api|access|private|auth)[_-]?key)["']?[ \t]*[:=][ \t]*["']?([0-9a-f]{32,})(?![0-9A-Za-z])""")
_THING = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
# A token of digits and their punctuation; what is left out ends a sentence or a bracket.
_GROUP = re.compile(r"[\"'\[<{]*(\(?\+?[0-9](?:[0-9()/.+-]*[0-9])?\)?)[.,;:!?\"'\])>}]*")
_BLANKS = re.compile(r"[ \t\xa0]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start, in code points."""
    out = [(0, a, b) for a, b in _emails(text)]
    if not _DIGITS.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def _things(text: str, taken: list[tuple[int, int, int]]):
    """Tokens with a digit or an @ that touch no base span; neighbouring groups of digits are one."""
    spans, at, k = sorted((a, b) for _, a, b in taken), 0, 0
    held = None  # (start, end) of groups so far
    while m := _THING.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        at = end
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        if k < len(spans) and spans[k][0] < end:
            at = max(at, spans[k][1])
            continue
        token = text[start:end]
        cut, stop = start + len(token) - len(token.lstrip("\"'([<{")), start + len(token.rstrip(".,;:!?\"')]>}"))
        if m := _GROUP.fullmatch(token):
            cut, stop = start + m.start(1), start + m.end(1)
        if held and m and cut == start and _BLANKS.fullmatch(text, held[1], cut):
            held = held[0], stop
            continue
        if held:
            yield held
        held = (cut, stop) if m else None
        if not m and stop > cut:
            yield cut, stop
    if held:
        yield held


def secret_spans(text: str) -> list[tuple[int, int]]:
    """Seeds of secrets."""
    return [m.span(1) for m in _SECRET.finditer(text)]


def _patterns(text: str, spans: list[tuple[int, int]]) -> list[list[str]]:
    """The patterns of each span, first the two tokens before it, in lower case with digits
    as 0; the start and end of the text count as tokens.  What stands in the span's own
    token before and after it are tokens.  Long tokens are named by a hash.  Patterns
    without a letter before the span are empty and count for nothing."""
    if not spans:
        return []
    bounds = [m.span() for m in _TOKEN.finditer(text)]
    starts, short, made, done = [a for a, _ in bounds], {}, {}, 0

    def named(x: str) -> str:
        x = _DIGITS.sub("0", x.lower())
        return x if len(x) <= CONTEXT_CHARS else hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()

    def token(i: int) -> str:
        if i < 0 or i >= len(bounds):
            return START if i < 0 else END
        if i not in short:
            short[i] = named(text[slice(*bounds[i])])
        return short[i]

    for a, b in sorted(spans):
        i = bisect.bisect_right(starts, a) - 1
        j = bisect.bisect_right(starts, b - 1) - 1
        own, rest = text[max(starts[i], min(done, a)) : a], text[b : bounds[j][1]]
        before = [*(token(k) for k in (i - 3, i - 2, i - 1)), *([named(own)] if own else [])]
        after = [*([named(rest)] if rest else []), token(j + 1), token(j + 2)]
        left = (before[-2:], before[-3:], before[-1:], before[-2:])
        found = (left[0], ["<<", *left[1]], [*left[2], "_", after[0]], [*left[3], "_", *after[:2]])
        made[a, b] = [" ".join(x) if any(c.isalpha() for t in y for c in t) else "" for x, y in zip(found, left)]
        done = max(done, b)
    return [made[x] for x in spans]


def _contexts(text: str, spans: list[tuple[int, int]]) -> list[str]:
    """The two tokens before each span."""
    return [x[0] for x in _patterns(text, spans)]


def _spans_text(spans) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for k, a, b in spans)


_MENTION = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("patterns", pa.list_(pa.string())), ("thing", pa.string())])
_FOUND = pa.struct([(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("base", pa.string()), ("mentions", pa.list_(_MENTION))])
_FOUND_DDL = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,base:string,mentions:array<struct<kind:int,start:bigint,end:bigint,patterns:array<string>,thing:string>>>"


def _find(column: pa.Array) -> pa.Array:
    out = []
    for x in column:
        text = x.as_py() or ""
        base = base_spans(text)
        joined = _spans_text(base)
        mentions = []
        secrets = [(SECRET, a, b) for a, b in secret_spans(text) if not any(x < b and a < y for _, x, y in base)]
        sure = [*base, *secrets]
        spans = [*sure, *((None, a, b) for a, b in _things(text, sure))]
        for (k, a, b), patterns in zip(spans, _patterns(text, [x[1:] for x in spans])):
            thing = hashlib.blake2b(text[a:b].lower().encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
            mentions.append({"kind": k, "start": a, "end": b, "patterns": patterns, "thing": thing})
        row = {f"n_{name}": sum(k == i for k, _, _ in base) for i, name in enumerate(KINDS)}
        out.append(row | {"base_sha256": hashlib.sha256(joined.encode()).hexdigest(), "base": joined, "mentions": mentions})
    return pa.array(out, _FOUND)


def bootstrap(mentions: DataFrame, *, seeds: int = SEEDS, rounds: int | None = None, belief: float = BELIEF) -> DataFrame:
    """(thing, kind, belief) of the things believed at ``belief`` or more that are no seeds,
    from (kind, pattern, thing) rows; rounds None: until a round adds none."""
    edges = workspace.Table(mentions.groupBy("pattern", "thing").agg(F.max("kind").alias("seed")), "edges").df
    sure = mentions.sparkSession.createDataFrame([], "thing string, kind int, belief double")
    while rounds is None or rounds > 0:
        judged = edges.join(sure, "thing", "left").select("pattern", "thing", F.coalesce("seed", "kind").alias("kind"), F.when(F.col("seed").isNotNull(), F.lit(1.0)).otherwise(F.col("belief")).alias("held"))
        support = judged.filter("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("n"), F.sum("held").alias("good"))
        total = support.groupBy("pattern").agg(F.sum("n").alias("total"))
        conf = support.filter(F.col("n") >= seeds).join(total, "pattern").select("pattern", F.col("kind").alias("of"), (F.col("good") / (F.col("total") + 1)).alias("conf")).filter(F.col("conf") >= TRUST)
        doubt = judged.filter("kind is null").join(conf, "pattern").groupBy("thing", "of").agg(F.sum(F.log(1 - F.col("conf"))).alias("doubt"))
        found = doubt.select("thing", F.round(1 - F.exp("doubt"), 9).alias("belief"), "of").filter(F.col("belief") >= belief)
        best = found.groupBy("thing").agg(F.min(F.struct((-F.col("belief")).alias("b"), "of")).alias("best"))
        new = workspace.Table(best.select("thing", F.col("best.of").alias("kind"), (-F.col("best.b")).alias("belief")), "believed").df
        if new.isEmpty():
            break
        sure = sure.union(new)
        rounds = rounds and rounds - 1
    return sure


def find_personal_data(docs: DataFrame, *, seeds: int = SEEDS, rounds: int | None = None, belief: float = BELIEF) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_secret of each document.

    n_added counts the spans that patterns found, n_secret all secrets, seeds or found.
    seeds: how many different things of a kind a pattern must stand round to take part.
    A null text is empty.  A thing that is believed of several kinds takes the first of
    those it is believed most of in the first round that believes it.  Other columns are ignored; repeated rows are all
    returned and, as the same things in the same places, count once in the graph.
    """
    workspace.ship(docs.sparkSession)
    find = F.arrow_udf(_find, _FOUND_DDL).asNondeterministic()
    found = docs.select(F.col("doc_id"), find(F.col("text").cast("string")).alias("f")).select("doc_id", F.monotonically_increasing_id().alias("row"), "f.*")
    found = workspace.Table(found, "personal").df
    mentions = found.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    held = bootstrap(mentions.select("kind", F.explode("patterns").alias("pattern"), "thing").filter("pattern <> ''"), seeds=seeds, rounds=rounds, belief=belief)
    sure = mentions.filter(F.col("kind") == SECRET).select("thing", F.lit(SECRET).alias("kind")).distinct()  # a secret is one wherever it stands
    held = held.select("thing", "kind").union(sure)
    more = mentions.filter("kind is null").join(held.select("thing", F.col("kind").alias("found")), "thing").select("row", F.col("found").alias("kind"), "start", "end", F.lit(1).alias("new"))
    added = more.union(mentions.filter(F.col("kind") == SECRET).select("row", "kind", "start", "end", F.lit(0).alias("new")))
    added = added.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"), F.sum("new").alias("n_added"), F.count_if(F.col("kind") == SECRET).alias("n_secret"))  # of one document
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    parse = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct((F.array_position(names, F.split(s, ":")[0]) - 1).cast("int").alias("kind"), F.split(s, ":")[1].cast("long").alias("start"), F.split(s, ":")[2].cast("long").alias("end")))
    merged = F.array_sort(F.concat(parse, F.col("added")))
    text = F.array_join(F.transform(merged, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    none = F.lit(0).cast("long")
    return found.join(added, "row", "left").select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", F.when(F.col("added").isNull(), F.col("base")).otherwise(text).alias("spans"), F.coalesce("n_added", none).alias("n_added"), F.coalesce("n_secret", none).alias("n_secret")
    )
