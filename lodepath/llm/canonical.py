"""Free-typed values mapped to the entries of a reference list, by repairing their tokens.

Distinct values are cut into tokens; the distinct tokens are joined to the tokens of the reference list by
edit distance (an equi-join on what is left after deletions, then the true distance, swaps counting one),
by abbreviation, and as entries written in one word; and the repaired tokens of a value are combined: an
entry is complete if each of its tokens is met, and complete entries are ranked by soft TF-IDF. A value
with no complete entry is reported as unmatched.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, small_join

# --- fixed values: customary short forms in job titles, and what they stand for ---
SHORT_FORMS = {
    "mgr": "manager", "mngr": "manager", "mgmt": "management", "eng": "engineer", "engr": "engineer", "dev": "developer", "devt": "development", "devel": "developer development",
    "spec": "specialist", "assoc": "associate", "asst": "assistant", "ops": "operations", "mktg": "marketing", "mkt": "marketing", "fin": "financial", "exec": "executive",
    "supvr": "supervisor", "supv": "supervisor", "tech": "technician technologist technologic", "tchn": "technician technologist", "admin": "administrative administrator", "acct": "account accountant accounts",
    "rep": "representative", "coord": "coordinator", "sw": "software", "mech": "mechanical mechanic", "elec": "electrical", "maint": "maintenance", "prod": "product production",
    "cust": "customer", "arch": "architect", "anlst": "analyst", "analyt": "analyst", "sci": "scientist science", "instr": "instructor", "attn": "attendant", "attd": "attendant",
    "proc": "process procurement", "dir": "director", "hr": "hr", "qa": "qa", "ml": "ml", "bi": "bi", "ui": "ui", "ux": "ux", "bus": "business", "biz": "business", "res": "research",
    "intl": "international", "lic": "licensed", "reg": "registered", "pract": "practical practitioner", "med": "medical", "phys": "physical", "occ": "occupational", "constr": "construction",
    "inv": "inventory", "whse": "warehouse", "wh": "warehouse", "sec": "security", "sys": "systems", "adj": "adjuster", "couns": "counsel counselor", "tchr": "teacher", "elem": "elementary",
    "math": "mathematics", "maths": "mathematics", "recep": "receptionist", "soc": "social", "db": "database", "dba": "dba", "pm": "pm", "op": "operator operations", "opr": "operator", "mtce": "maintenance", "mfg": "manufacturing", "splst": "specialist", "qual": "quality", "accts": "accounts", "oper": "operator",
}
#: Words that begin what is no longer the occupation: the place or the employer.
TAIL = re.compile(r"\s+(?:at|in|@|near|for|with|bei|chez|en|à)\s+.*$|\s+[-–—|/]\s+.*$|\s*[#*].*$|\(.*?(?:\)|$)|\[.*?(?:\]|$)", re.I)
_WORD = re.compile(r"[^\W_]+")


class Forms:
    """Customary short forms and what they stand for; any list of them, or none."""

    def __init__(self, short_forms: dict[str, str]):
        #: The words that a short form stands for, and the short forms of a word.
        self.words = {s: w.split() for s, w in short_forms.items()}
        self.of: dict[str, list[str]] = {}
        for s, ws in self.words.items():
            for w in ws:
                self.of.setdefault(w, []).append(s)
        #: Letters of the longest short form; what is a misspelt one has one more at most.
        self.longest = max(map(len, self.words), default=0)

    def long_of(self, word: str) -> list[str]:
        """The short forms of a word that have letters enough to be misspelt or joined."""
        return [s for s in self.of.get(word, ()) if len(s) > 2]


def fold(s: str) -> str:
    """Lower case without accents; compatibility forms as their plain ones."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if not unicodedata.combining(c))


def tokens(s: str) -> list[str]:
    """Tokens of folded text; an apostrophe within a word joins."""
    return _WORD.findall(re.sub(r"(?<=\w)['’](?=\w)", "", fold(s)))


def _camel(s: str) -> str:
    return re.sub(r"(?<=[a-zà-ÿ]{2})(?=[A-ZÀ-Þ][a-zà-ÿ])", " ", s)


def value_tokens(value: str) -> list[str]:
    """Tokens of a value's head; neighbours joined to one word are added.

    The head ends where place or employer begin; a value that has nothing before them is head as a whole.
    """
    s = unicodedata.normalize("NFKC", value)
    head, out = TAIL.sub(" ", s), {}
    if not tokens(head):
        head = s
    for form in {head, _camel(head)}:
        ts = tokens(form)
        out |= dict.fromkeys([*ts, *(a + b for a, b in zip(ts, ts[1:], strict=False))])
    return list(out)


def allowed(length: int) -> int:
    """Edits that a reference token of some length may have: one a word; more only where words are written as one."""
    return 0 if length < 4 else 1 if length < 12 else 2


def deletions(token: str, depth: int) -> set[str]:
    """What is left of a token after up to depth deletions."""
    out = last = {token}
    for _ in range(depth):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        out = out | last
    return out


def distance(a: str, b: str) -> int:
    """Edit distance where a swap of neighbours counts one."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1]


def _abbreviates(short: str, long: str) -> bool:
    """Letters of the long word in order, first and last ones kept, or its beginning."""
    if len(short) < 3 or len(short) > 0.75 * len(long) or short[0] != long[0]:
        return False
    if long.startswith(short):
        return True
    rest = iter(long)
    return short[-1] == long[-1] and all(c in rest for c in short)


def _abbreviation_keys(t: str, as_short: bool) -> set[str]:
    """Keys that a short form of a word shares with it: its beginning, or its first, second, third and last letters in order.

    A short form has one key of each kind. A word has one for each of its beginnings, and one for each way to leave
    letters out between the four, so that unlike words that begin and end alike seldom meet.
    """
    if len(t) < 3:
        return set()
    if as_short:
        return {"^" + t, f"~{t[0]}{t[1]}{t[2] if len(t) > 3 else ''}~{t[-1]}"}
    inner = t[1:-1]
    out = {"^" + t[:n] for n in range(3, int(0.75 * len(t)) + 1)}
    out |= {f"~{t[0]}{a}~{t[-1]}" for a in set(inner)}
    return out | {f"~{t[0]}{inner[i]}{inner[j]}~{t[-1]}" for i in range(len(inner)) for j in range(i + 1, len(inner))}


def _spread(forms: Forms, with_short: bool, longest: int):
    """(token, key): under which keys a token may meet a reference token, whose letters are `longest` at most."""

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                if with_short and len(t) > longest + allowed(longest):
                    continue  # more letters than any reference token and its edits: it meets none
                out += [(t, "=" + k) for k in deletions(t, 2 if len(t) > 9 else 1 if len(t) > 2 else 0)]
                out += [(t, k) for k in _abbreviation_keys(t, with_short)]
                if with_short:
                    out += [(t, "=" + w) for w in forms.words.get(t, ())]
                    out += [(t, "'" + k) for k in deletions(t, 1)] if 2 < len(t) <= forms.longest + 1 else []
                else:
                    out += [(t, "'" + k) for s in forms.long_of(t) for k in deletions(s, 1)]
            cols = list(zip(*out, strict=True)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["token", "key"])

    return run


def similarity(token: str, word: str, forms: Forms) -> float:
    """How well a token stands for a reference token: 1 the same, 0 not at all."""
    if token == word:
        return 1.0
    if word in forms.words.get(token, ()):
        return 0.95
    limit = allowed(len(word))
    if abs(len(token) - len(word)) <= limit and (d := distance(token, word)) <= limit:
        return 1 - d / max(len(token), len(word))
    if _abbreviates(token, word) or any(distance(token, s) == 1 for s in forms.long_of(word)):
        return 0.6
    return 0.0


def _compare(forms: Forms):
    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            s = pa.array([similarity(x, y, forms) for x, y in zip(a, b, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), s], names=["token", "word", "sim"])

    return run


def match_tokens(distinct: DataFrame, vocabulary: DataFrame, forms: Forms) -> DataFrame:
    """(token, word, sim) of the pairs of tokens that may stand for each other, joined on keys, never crossed.

    No token is left out for its length: one that is longer than every reference token by more than the edits allowed
    has no partner.
    """
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    longest = vocabulary.agg(F.max(F.length("word"))).first()[0] or 0
    left = distinct.select("token").repartition(tasks, "token").mapInArrow(_spread(forms, True, longest), "token string, key string")
    right = vocabulary.select(F.col("word").alias("token")).mapInArrow(_spread(forms, False, longest), "token string, key string").withColumnRenamed("token", "word")
    # a word has up to hundreds of keys, which the planner doesn't know: they are counted before they are broadcast
    pairs = small_join(left, materialise(right), ["key"]).select("token", "word").distinct()
    # distances are slow and pairs are small: they are dealt to all tasks, whatever was merged before
    return pairs.repartition(tasks, "token", "word").mapInArrow(_compare(forms), "token string, word string, sim double").filter("sim > 0")


def _explode_values(batches):
    for batch in batches:
        out = []
        for v in batch.column(0).to_pylist():
            out += [(v, t) for t in value_tokens(v)]
        cols = list(zip(*out, strict=True)) if out else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["value", "token"])


def _variants(forms: Forms):
    """(entry, variant, word, size): the tokens of each entry's names, and each name of several tokens in one word."""

    def run(rows):
        for batch in rows:
            out = []
            for entry, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ts = list(dict.fromkeys(tokens(name)))
                out += [(entry, name, t, len(ts)) for t in ts]
                if len(ts) > 1:  # in one word, also with one or all tokens in a short form
                    ways = [[t, *forms.long_of(t)] for t in ts]
                    written = {"".join(ts), "".join(f[-1] for f in ways)}
                    written |= {"".join([*ts[:i], s, *ts[i + 1 :]]) for i, f in enumerate(ways) for s in f}
                    out += [(entry, f"{name}\x1f{w}", w, 1) for w in sorted(written) if len(w) > 5]
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int32()), strict=True)], names=["entry", "variant", "word", "size"])

    return run


def map_values(values: DataFrame, column: str, reference: DataFrame, entry: str, name: str, aliases: str, short_forms: dict[str, str] | None = None) -> DataFrame:
    """(value, entry, score) of each distinct non-null value of a column; entry is null where none is complete.

    aliases: a column of JSON array text with further names, or null. short_forms: words by their customary short forms,
    SHORT_FORMS if not given; with none, edits and abbreviations by the letters that are left remain. Ties go to the smaller entry. An empty
    reference leaves all values unmatched.
    """
    forms = Forms(SHORT_FORMS if short_forms is None else short_forms)
    names = reference.select(F.col(entry).cast("long").alias("entry"), F.explode(F.concat(F.array(name), F.coalesce(F.from_json(aliases, "array<string>"), F.array().cast("array<string>")))).alias("name")).filter("name is not null")
    parts = materialise(names.mapInArrow(_variants(forms), "entry long, variant string, word string, size int"))
    total = parts.select("entry").distinct().count()
    weight = parts.groupBy("word").agg((F.log(F.lit(1.0 + total)) - F.log(F.count_distinct("entry"))).alias("idf"))
    parts = materialise(parts.join(weight, "word"))
    distinct = values.select(F.col(column).alias("value")).filter("value is not null").distinct()
    # a number of partitions that is not merged away: cutting is slow, though the values are small
    parted = distinct.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), "value")
    cut = materialise(parted.mapInArrow(_explode_values, "value string, token string"))
    matches = materialise(match_tokens(cut.select("token").distinct(), parts.select("word").distinct(), forms))
    met = small_join(cut, matches, ["token"]).groupBy("value", "word").agg(F.max("sim").alias("sim"))
    hits = small_join(met, parts, ["word"])
    scored = hits.groupBy("value", "entry", "variant", "size").agg(
        F.count(F.lit(1)).alias("n"), F.max("sim").alias("best"), (F.sum(F.pow("idf", 2) * F.col("sim")) / F.sqrt(F.sum(F.pow("idf", 2)))).alias("score")
    )
    # complete entries; a guessed abbreviation alone names nothing
    ranked = scored.filter((F.col("n") == F.col("size")) & ((F.col("best") > 0.6) | (F.col("size") > 1)))
    best = ranked.groupBy("value").agg(F.max(F.struct("score", (-F.col("entry")).alias("minus"))).alias("b"))
    return distinct.join(best, "value", "left").select("value", (-F.col("b.minus")).alias("entry"), F.col("b.score").alias("score"))
