"""Personal data: fixed patterns, then bootstrapped contextual extraction.

Fixed patterns find e-mail addresses, IP addresses, cards and phones; these spans always stay. They are also the seeds
of a bootstrap. Each task lists, besides the seeds, the strings of nearly the same shape that the fixed patterns turned
down (a number with a wrong check digit, a phone without a country code, an address with a part over 255), with the words
around them. Contexts of a kind are patterns: the word before, the two before, the word after, and before with after. On
the graph of patterns and instances Spark scores in rounds: a pattern is as good as the share of its instances that are
believed to be of the kind, given ``SUPPORT`` different believed ones; an instance is believed as far as its best patterns
say. Candidates that good patterns hold are added, and those that are a seed of another place, written differently. A pattern that also holds many other things scores low, so
clean texts gain nothing.

Secrets are a kind of the method's own, listed after the four: a long value of letters and digits that is assigned to a name
such as ``token`` or ``api_key`` is a seed, other long words of letters and digits are candidates. They are added spans, never base ones.

Texts never move; edges of the graph are combined before each shuffle, and a word that precedes a third of all instances
is a key of partial sums or of a join that Spark may split. NULL and empty texts have no spans. Repeated rows and NULL
ids are kept apart by a row number that is written once. Texts without spaces and very long texts take linear time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from twinloom.session import cut

KINDS = ["email", "ip", "card", "phone"]
#: With the kind that only the method adds.
NAMES = [*KINDS, "secret"]
SECRET = len(KINDS)
ROUNDS = 3
SUPPORT = 5
BELIEVED = 0.8

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# from the first digit of a run: a match that starts later in the run would need the same rest
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Strings of nearly the same shape.
NEAR = {
    "email": re.compile(r"(?<![^\s<>\"'(),;:])[^\s<>\"'(),;:@]{1,64}+@[^\s<>\"'(),;:@]{1,254}[^\s<>\"'(),;:@.!?]"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,4}+(?:\.[0-9]{1,4}+){3}(?!\.?[0-9])"),
    "card": re.compile(r"(?<![0-9-])[0-9](?:[\x20-]?[0-9]){11,19}+(?![0-9-])"),
    "phone": re.compile(r"(?<![0-9(.+-])(?:(?:\([0-9]{2,4}\)[\x20.-]?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}|[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){2,4})(?![.-]?[0-9])|[0-9]{7,15}+(?![.-]?[0-9]))"),
    "secret": re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,512}+(?![A-Za-z0-9_-])"),
}
#: A value that something is assigned to, and the names that make it a secret.
ASSIGNED = re.compile(r"[=:]>?[\x20\t]{0,3}[\"']?([A-Za-z0-9+/_=.-]{16,512}+)")
SECRET_NAME = re.compile(r"(?:token|secret|passwd|password|passphrase|credential|api[\x20_-]?key|access[\x20_-]?key|private[\x20_-]?key)s?[\"']?[\x20\t]{0,3}$", re.IGNORECASE)
WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out, seen = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            at = m.start()
            while at > seen and text[at - 1] in LOCAL:
                at -= 1
            if at < m.start():
                out.append((0, at, m.end()))
                seen = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = digits_of(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def mixed(value: str) -> bool:
    """Letters and digits both."""
    return any("0" <= c <= "9" for c in value) and any("a" <= c <= "z" or "A" <= c <= "Z" for c in value)


def secret_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Values assigned to the name of a secret that touch no span already taken."""
    out = []
    for m in ASSIGNED.finditer(text):
        if mixed(m.group(1)) and SECRET_NAME.search(text[max(0, m.start() - 24) : m.start()]):
            s, e = m.start(1), m.start(1) + len(m.group(1).rstrip("."))
            if not any(a < e and s < b for _, a, b in taken):
                out.append((SECRET, s, e))
    return out


def seed_spans(text: str) -> list[tuple[int, int, int]]:
    """What the bootstrap starts from: base spans, then secrets."""
    base = base_spans(text)
    return base + secret_spans(text, base)


def near_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Strings of nearly a kind's shape that touch no seed and not each other (kinds as listed go first)."""
    busy = sorted((s, e) for _, s, e in taken)
    out = []
    for k, kind in enumerate(NAMES):
        if kind == "email" and "@" not in text:
            continue
        for m in NEAR[kind].finditer(text):
            if (k != SECRET or mixed(m.group())) and not any(s < m.end() and m.start() < e for s, e in busy):
                out.append((k, m.start(), m.end()))
        busy = sorted(busy + [(s, e) for j, s, e in out if j == k])
    return out


def bare(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}<>|=").lower()


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span."""
    left = WORD.findall(text[max(0, start - 120) : start])
    right = WORD.findall(text[end : end + 60])
    one, two = bare(left[-1]) if left else "^", " ".join(map(bare, left[-2:])) if left else "^"
    after = bare(right[0]) if right else "$"
    return [f"L {one}", f"LL {two}", f"R {after}", f"B {one} _ {after}"]


def instance(kind: int, value: str) -> int:
    """A number that stands for a string: strings themselves are not written. The dots of an address tell it from others."""
    plain = value if kind == SECRET else value.lower() if kind < 2 else digits_of(value)
    return int.from_bytes(hashlib.blake2b(f"{kind} {plain}".encode(), digest_size=8).digest(), "little", signed=True)


FOUND = "array<struct<kind:int,start:long,end:long,seed:boolean,instance:long,patterns:array<string>>>"


def located(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, found): every seed and candidate of every text."""
    ids = docs.schema[key].dataType.simpleString()
    held = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column("t").to_pylist():
                sure = seed_spans(t)
                rows = [(k, s, e, True) for k, s, e in sure] + [(k, s, e, False) for k, s, e in near_spans(t, sure)]
                found.append(
                    [{"kind": k, "start": s, "end": e, "seed": seed, "instance": instance(k, t[s:e]), "patterns": contexts(t, s, e)} for k, s, e, seed in rows]
                )
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), pa.array(found, KIND_TYPE)], names=["row", "id", "found"])

    return held.mapInArrow(searched, f"row long, id {ids}, found {FOUND}")


KIND_TYPE = pa.list_(
    pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))])
)


def believed(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, enough: float = BELIEVED) -> DataFrame:
    """(kind, instance): the seeds, and the unseen instances that good patterns hold."""
    one = found.select(F.explode("found").alias("f")).select("f.kind", "f.instance", "f.seed", F.explode("f.patterns").alias("pattern"))
    edges = cut(one.groupBy("pattern", "kind", "instance").agg(F.max("seed").alias("seed")))
    belief = edges.groupBy("kind", "instance").agg(F.max(F.col("seed").cast("double")).alias("belief"))
    for _ in range(rounds):
        belief = cut(belief)
        sure = F.when(F.col("belief") >= enough, F.col("belief")).otherwise(0.0)
        held = edges.join(belief, ["kind", "instance"])
        # what else stands in the same place, of any kind, counts against a pattern
        per = held.groupBy("pattern", "kind").agg(F.sum(sure).alias("good"), F.sum((sure > 0).cast("int")).alias("n_good"), F.count(F.lit(1)).alias("n"))
        whole = per.groupBy("pattern").agg(F.sum("n").alias("all"))
        score = per.where(F.col("n_good") >= support).join(whole, "pattern").select("pattern", "kind", (F.col("good") / F.col("all")).alias("score"))
        fresh = edges.where("not seed").join(score.where(F.col("score") >= enough), ["pattern", "kind"])
        fresh = fresh.groupBy("kind", "instance").agg(F.max("score").alias("belief"))
        belief = edges.where("seed").select("kind", "instance", F.lit(1.0).alias("belief")).distinct().unionByName(fresh).groupBy("kind", "instance").agg(F.max("belief").alias("belief"))
        rest = edges.select("kind", "instance").distinct().join(belief, ["kind", "instance"], "left_anti").withColumn("belief", F.lit(0.0))
        belief = belief.unionByName(rest)
    return cut(belief.where(F.col("belief") >= enough).select("kind", "instance"))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, added): spans (kind, start, end) of each document, sorted."""
    found = cut(located(docs, key, text))
    new = believed(found)
    pick = lambda test: F.transform(F.filter("found", test), lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    cand = found.where(F.exists("found", lambda f: ~f["seed"])).select("row", F.explode("found").alias("f")).where("not f.seed")
    took = cand.select("row", "f.kind", "f.instance", "f.start", "f.end").join(new, ["kind", "instance"])
    more = took.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    own = found.select(
        "row", F.col("id").alias(key), F.sort_array(pick(lambda f: f["seed"] & (f["kind"] < SECRET))).alias("base"), pick(lambda f: f["seed"] & (f["kind"] == SECRET)).alias("secrets"))
    out = own.join(more, "row", "left")
    return out.select(key, "base", F.sort_array(F.concat("secrets", F.coalesce("added", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))).alias("added"))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined, of sorted spans."""
    name = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", F.element_at(name, f["kind"] + 1), f["start"], f["end"])), ",")


def reported(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found): counts and digest of the base spans, all spans, and
    how many they are, added ones included; a document holds personal data as far as this tells if ``n_found`` is above 0."""
    held = spans(docs, key, text)
    kinds = F.transform("base", lambda f: f["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    both = F.sort_array(F.concat("base", "added"))
    total = F.size(both).cast("long").alias("n_found")
    return held.select(key, *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(both).alias("spans"), total)
