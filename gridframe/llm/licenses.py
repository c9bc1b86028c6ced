"""License scan by sentence rules.

Texts are normalised (ASCII lower case, letters and digits only) and cut. Hard cuts are
sentence ends and blank lines, also lines without a letter or digit; not ``v.`` before a
number, nor a few abbreviations. Soft cuts are line ends, ``;``, ``:``, brackets, double quotes and signs of
comments. A known licence sentence stands between two cuts and may hold soft ones, so
wrapped texts, list items and clauses are known as well as whole sentences; of several
that start at one place the longest counts, and one that starts inside another does not.
Each gets its identifier.

The identifiers of a document are matched against ordered rules: at each place the
first rule counts whose identifiers follow there in order, other sentences allowed
between them up to ``max_gap`` words a step. Titles, copyright lines and other known
sentences may stand between. A match inside an earlier one that reaches as far is dropped.
``first_word`` counts the words before the match.

Everything happens within a row, so there is no shuffle, no key and no group. Only texts
that hold a word every known sentence has one of are cut at all. DataFrame functions only.

Defined results: null and empty texts match nothing; every row is a document of its own,
whatever its id, so repeated rows give repeated results and null ids stay null; very long
texts are read whole; extra columns of any name are left aside; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .license_rules import ARTICLES, NAME_SID, PHRASES, PREFIXES, RULES, SENTENCES, SID

#: Words between two sentences of a rule, on average, at most.
MAX_GAP = 100

#: Every known sentence holds one of these.
ANCHORS = r"licen|permission|redistribut|permitted|public domain|provided|misrepresented|warrant|wtfpl|freedom|liable|advertising|terms and conditions|(?:lesser|library)\s+gpl|relinquish|jurisdictions|copy modify publish|endorse|copy of the mpl|artistic control|(?:releas|distribut|publish|avail)\w*\s+under"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Patterns of the normal form, in order, and what they become; "|" is a hard cut, a line end a soft one.
STEPS = [
    (r"(^|[^a-z0-9])v\.[ \t\r\n#*/]+([0-9])", "{1}v {2}"),
    (r"(^|[^a-z0-9])(inc|ltd|corp|co|llc|dr|mr|mrs|ms|no|st)\.", "{1}{2} "),
    (r"[.!?]+[\"')\]]*([ \t\r\n]|\z)", "|"),
    (r"\n[^a-z0-9\n]*\n", "|"),
    (r"[\n\r;:(){}<>\"*#\[\]]|//|--", "\n"),
    (r"[^a-z0-9\n|]+", " "),
    (r"[ \n]*[|][ \n|]*", "|"),
    (r" *\n[ \n]*", "\n"),
    (r"^[ \n|]+|[ \n|]+\z", ""),
]
WORDS = "(?:[a-z0-9]+[ \n]){1,12}?"


def pattern(sentences: list[str]) -> str:
    """Regular expression of any of the sentences, shared beginnings once, longer ones first."""
    tree: dict = {}
    for sentence in sentences:
        at = tree
        for word in sentence.split():
            at = at.setdefault(word, {})
        at[""] = {}

    def written(at: dict, first: bool) -> str:
        """What may follow; a blank goes before every word but the first."""
        out = []
        for word, below in at.items():
            if word:
                text = ("" if first else "[ \n]") + word
                out.append(text + written(below, False))
        if len(out) == 1 and "" not in at:
            return out[0]
        body = f"(?:{'|'.join(out)})" if out else ""
        return body + "?" if body and "" in at else body

    return written(tree, True)


def with_words(sentence: str) -> str:
    """Regular expression of a sentence with variable words."""
    return f"[ \n]{WORDS}".join(p.replace(" ", "[ \n]") for p in sentence.split(" * "))


EXACT = [s for s in SENTENCES.values() if "*" not in s]
VARIABLE = {SID[k]: with_words(s) for k, s in SENTENCES.items() if "*" in s}
PREFIX = pattern([p.strip() for p in PREFIXES])
NAME = pattern([name for _, name in PHRASES])
PHRASE = rf"{PREFIX}[ \n](?:(?:{'|'.join(a.strip() for a in ARTICLES if a)})[ \n])?({NAME})"
HIT = rf"(?<![^\n|])(?:{pattern(EXACT)}|{'|'.join(VARIABLE.values())}|{PHRASE})(?![^\n|])"
LONGEST = max(len(ids) for _, ids in RULES)


def normal(text: Column) -> Column:
    """Words of a text with cuts between them."""
    out = F.translate(text, UPPER, LOWER)
    for find, put in STEPS:
        out = F.regexp_replace(out, find, put.replace("{", "$").replace("}", ""))
    return out


def identifier(hit: Column) -> Column:
    """Number of a known sentence."""
    plain = F.translate(hit, "\n", " ")
    at = F.array_position(F.array(*map(F.lit, EXACT)), plain)
    ids = F.array(*[F.lit(SID[k]) for k, s in SENTENCES.items() if "*" not in s])
    out = F.when(at > 0, F.get(ids, (at - 1).cast("int")))
    for sid, known in VARIABLE.items():
        out = out.when(hit.rlike(f"^(?:{known})$"), sid)
    name = F.array_position(F.array(*[F.lit(n) for _, n in PHRASES]), F.translate(F.regexp_extract(hit, f"^{PHRASE}$", 1), "\n", " "))
    return out.otherwise(name.cast("int") + len(SENTENCES))


def scan(docs: DataFrame, max_gap: int = MAX_GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, rule, first_word, n_sentences): every rule recognised, in place."""
    text = F.col(text_col)
    some = docs.select(F.col(id_col).alias("id"), text.alias("text")).where(F.translate("text", UPPER, LOWER).rlike(ANCHORS))
    parts = some.select("id", F.split(F.regexp_replace(normal(F.col("text")), HIT, "\x01$0\x02"), "\x01").alias("parts")).where(F.size("parts") > 1)
    seps = F.transform("parts", lambda p: F.regexp_count(p, F.lit("[ \n|]")))
    places = F.aggregate(seps, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    placed = parts.select("id", "parts", places.alias("places"))
    words = lambda hit: F.regexp_count(hit, F.lit("[ \n]")) + 1
    hit = lambda i: F.split_part(F.get("parts", i), F.lit("\x02"), F.lit(1))
    numbers = F.sequence(F.lit(1), F.size("parts") - 1)
    hits = F.transform(numbers, lambda i: F.struct(identifier(hit(i)).alias("sid"), F.get("places", i).alias("at"), words(hit(i)).alias("words")))
    known = placed.select("id", hits.alias("hits"))

    several = [(n, name, ids) for n, (name, ids) in enumerate(RULES, 1) if len(ids) > 1]
    sequences = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(name).alias("license"), F.array(*map(F.lit, ids)).alias("ids")) for n, name, ids in several])
    alone = {ids[0]: n for n, (_, ids) in reversed(list(enumerate(RULES, 1))) if len(ids) == 1}
    single = F.array(*[F.lit(alone.get(sid, 0)) for sid in range(1, len(SENTENCES) + len(NAME_SID) + 1)])
    licenses = F.array(*[F.lit(name) for name, _ in RULES])

    def reached(rule: Column, i: Column) -> Column:
        """End of a sequence rule that starts at hit i; null if it does not fit."""
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"), F.lit(0).alias("own"))
        ahead = F.slice("hits", i + 1, LONGEST + max_gap * (LONGEST - 1))  # each has a word, so more are too far away
        def step(s: Column, x: Column) -> Column:
            meets = (s["n"] < F.size(rule["ids"])) & (x["sid"] == F.get(rule["ids"], s["n"]))
            return F.when(meets, F.struct((s["n"] + 1).alias("n"), (x["at"] + x["words"]).alias("end"), (s["own"] + x["words"]).alias("own"))).otherwise(s)

        n = F.size(rule["ids"])
        return F.aggregate(ahead, start, step, lambda s: F.when((s["n"] == n) & (s["end"] - F.get("hits", i)["at"] - s["own"] <= max_gap * (n - 1)), s["end"]))

    def match(i: Column) -> Column:
        here = F.get("hits", i)
        begun = F.filter(sequences, lambda r: F.get(r["ids"], F.lit(0)) == here["sid"])
        tried = F.transform(begun, lambda r: F.struct(r["rule"].alias("rule"), r["license"].alias("license"), here["at"].alias("at"), reached(r, i).alias("end"), F.size(r["ids"]).alias("n")))
        found = F.filter(tried, lambda m: m["end"].isNotNull())
        rule = F.get(single, here["sid"] - 1)
        own = F.struct(rule.alias("rule"), F.get(licenses, rule - 1).alias("license"), here["at"].alias("at"), (here["at"] + here["words"]).alias("end"), F.lit(1).alias("n"))
        return F.coalesce(F.get(found, F.lit(0)), own)

    matches = known.select("id", F.filter(F.transform(F.sequence(F.lit(0), F.size("hits") - 1), match), lambda m: m["rule"] > 0).alias("m"))
    before = F.aggregate("m", F.array(F.lit(0)), lambda acc, m: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), m["end"]))))
    kept = matches.select("id", "m", before.alias("reach")).select("id", F.explode(F.filter("m", lambda m, k: m["end"] > F.get("reach", k))).alias("m"))
    return kept.select("id", "m.license", "m.rule", F.col("m.at").alias("first_word"), F.col("m.n").alias("n_sentences"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def sql_steps(text: str) -> str:
    for find, put in [(f"[{UPPER}]", None), *STEPS]:
        text = f"translate({text}, '{UPPER}', '{LOWER}')" if put is None else "regexp_replace({}, '{}', '{}', 'g')".format(text, find.replace("'", "''").replace("\n", r"\n"), put.replace("{", "\\").replace("}", "").replace("\n", "' || chr(10) || '"))
    return text


#: Known sentences compared as runs of whole pieces, rules as a walk from hit to hit.
ORACLE = rf"""
WITH RECURSIVE exact(sid, known) AS (VALUES {", ".join(f"({SID[k]}, '{s}')" for k, s in SENTENCES.items() if "*" not in s)}),
variable(sid, known) AS (VALUES {", ".join(f"({sid}, '{p.replace(chr(10), '')}')" for sid, p in VARIABLE.items())}),
names(sid, name) AS (VALUES {", ".join(f"({NAME_SID[n]}, '{n}')" for _, n in PHRASES)}),
prefixes(prefix) AS (VALUES {", ".join(f"('{p}{a}')" for p in PREFIXES for a in ARTICLES)}),
rules(rule, license, sids) AS (VALUES {", ".join(f"({n}, '{name}', {list(ids)})" for n, (name, ids) in enumerate(RULES, 1))}),
pieces AS (
  SELECT doc_id, row_number() OVER () AS rid, string_split(regexp_replace({sql_steps('text')}, '[|]', chr(10) || '|' || chr(10), 'g'), chr(10)) AS p
  FROM documents WHERE regexp_matches(translate(text, '{UPPER}', '{LOWER}'), '{ANCHORS}')),
known AS (SELECT sid, known FROM exact UNION SELECT sid, prefix || name FROM names, prefixes),
starts AS (
  SELECT doc_id, rid, p, unnest(range(1, len(p) + 1)) AS a FROM pieces),
runs AS (
  SELECT doc_id, rid, a, unnest(range(a, least(a + 80, len(p) + 1))) AS b, p FROM starts
  WHERE split_part(p[a], ' ', 1) IN (SELECT split_part(known, ' ', 1) FROM known UNION SELECT 'neither')),
texts AS (SELECT doc_id, rid, a, b, array_to_string(p[a:b], ' ') AS t, array_to_string(list_filter(p[1:a - 1], lambda x: x <> '|'), ' ') AS ahead FROM runs WHERE NOT list_contains(p[a:b], '|')),
met AS (
  SELECT doc_id, rid, a, b, t, ahead, sid FROM texts JOIN known ON t = known
  UNION ALL SELECT doc_id, rid, a, b, t, ahead, sid FROM texts JOIN variable ON regexp_full_match(t, known)),
longest AS (
  SELECT doc_id, rid, a, max(b) AS b, arg_max(sid, b) AS sid, arg_max(len(string_split(t, ' ')), b) AS words, any_value(CASE WHEN ahead = '' THEN 0 ELSE len(string_split(ahead, ' ')) END) AS place
  FROM met GROUP BY doc_id, rid, a),
hits AS (
  SELECT doc_id, rid, a, b, sid, words, place FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY a) AS n FROM longest) WHERE n = 1
  UNION ALL
  SELECT l.doc_id, l.rid, min(l.a), arg_min(l.b, l.a), arg_min(l.sid, l.a), arg_min(l.words, l.a), arg_min(l.place, l.a)
  FROM hits h JOIN longest l ON l.rid = h.rid AND l.a > h.b GROUP BY l.doc_id, l.rid, h.a),
walk AS (
  SELECT doc_id, rid, place AS first, rule, license, sids, 1 AS n, place, place + words AS reach, words AS own FROM hits JOIN rules ON sids[1] = sid
  UNION ALL
  SELECT w.doc_id, w.rid, w.first, w.rule, w.license, w.sids, w.n + 1, min(h.place), arg_min(h.place + h.words, h.place), any_value(w.own) + arg_min(h.words, h.place)
  FROM walk w JOIN hits h ON h.rid = w.rid AND h.place > w.place AND h.sid = w.sids[w.n + 1] GROUP BY ALL),
best AS (
  SELECT rid, first, min(rule) AS rule, arg_min(doc_id, rule) AS doc_id, arg_min(license, rule) AS license, arg_min(reach, rule) AS reach, arg_min(n, rule) AS n
  FROM walk WHERE n = len(sids) AND reach - first - own <= {MAX_GAP} * (n - 1) GROUP BY rid, first)
SELECT doc_id, license, rule::int AS rule, first::int AS first_word, n::int AS n_sentences FROM (
  SELECT *, max(reach) OVER (PARTITION BY rid ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM best)
WHERE earlier IS NULL OR reach > earlier
"""
