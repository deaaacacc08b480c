"""What the corpus itself teaches: sentence ends, tags, words of unspaced script, polarities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lexicon, segmenting, splitting, tagging
from ..operators.checkpoints import cut
from .registry import Tables, query
from .scans import GOLD, gold

# Sentence ends.

BARE = r"regexp_replace(regexp_replace(regexp_replace({x}, '[ \t\r\n]+\z', ''), '[\"'')\]}},;:]+\z', ''), '^[\"''(\[{{]+', '')"
KIND = r"CASE WHEN regexp_matches(regexp_replace(lower({x}), '\.+\z', ''), '^[0-9][0-9.,]*\z') THEN '#' ELSE regexp_replace(lower({x}), '\.+\z', '') END"
CUT = r"regexp_extract_all(text, '[^ \t\r\n]+[ \t\r\n]*|[ \t\r\n]+')"


def told_sql(k: str, n: str, p: str) -> str:
    part = lambda times, rate: f"CASE WHEN {times} > 0 THEN ({times}) * ln({rate}) ELSE 0 END"
    return f"({part(k, p)} + {part(f'({n}) - ({k})', f'1 - ({p})')})"


def ratio_sql(a: str, b: str, ab: str, n: str) -> str:
    a, b, ab, n = (f"({c})::DOUBLE" for c in (a, b, ab, n))
    rest = f"greatest({n} - {a}, 1.0)"
    one = f"({told_sql(ab, a, f'{b} / {n}')} + {told_sql(f'{b} - {ab}', rest, f'{b} / {n}')})"
    return f"2 * ({told_sql(ab, a, f'{ab} / {a}')} + {told_sql(f'{b} - {ab}', rest, f'({b} - {ab}) / {rest}')} - {one})"


_SIZE = "length(replace(kind, '.', ''))"
COUNTED = rf"""held AS (SELECT list_filter({CUT}, lambda x: NOT regexp_full_match(x, '[ \t\r\n]+')) AS p FROM documents),
near AS (SELECT unnest(p) AS piece, unnest(list_append(p[2:], NULL)) AS after FROM held), bare AS (SELECT piece, {BARE.format(x="piece")} AS word, {BARE.format(x="after")} AS after FROM near),
found AS MATERIALIZED (SELECT {KIND.format(x="word")} AS kind, ends_with(word, '.') AND NOT ends_with(word, '..') AS stop, contains(piece, chr(10)) AS line, regexp_matches(word, '[!?]\z') AS ends, CASE WHEN after IS NOT NULL THEN {KIND.format(x="after")} END AS next FROM bare),
counts AS (SELECT kind, count(*) AS n, count(*) FILTER (stop) AS stopped FROM found GROUP BY kind), total AS (SELECT sum(n)::DOUBLE AS every, sum(stopped)::DOUBLE AS stops FROM counts),
scored AS (SELECT kind, stopped, n - stopped AS plain, 2 * ({told_sql("stopped", "n", "0.99")} - {told_sql("stopped", "n", "stops / every")}) * exp(-{_SIZE}) * (length(kind) - {_SIZE} + 1) * pow({_SIZE}::DOUBLE, -(n - stopped)::DOUBLE) AS score
FROM counts, total WHERE stopped > 0 AND regexp_matches(kind, '[^0-9._,#-]') AND {_SIZE} > 0),
short AS (SELECT kind FROM scored WHERE score >= 0.3)"""
STARTED = rf"""{COUNTED}, marked AS (SELECT f.*, s.kind IS NOT NULL AS short FROM found f LEFT JOIN short s ON f.kind = s.kind), sure AS (SELECT next FROM marked WHERE next IS NOT NULL AND (ends OR line OR (stop AND NOT short))),
after AS (SELECT next AS kind, count(*) AS ab FROM sure GROUP BY next), starters AS (SELECT * FROM (SELECT kind, {ratio_sql("a", "n", "ab", "every")} AS score FROM after JOIN counts USING (kind), total, (SELECT count(*) AS a FROM sure) WHERE ab::DOUBLE / a > n / every AND regexp_matches(kind, '^[^0-9._,#-]+\z')) WHERE score >= 30),
met AS (SELECT kind, next, count(*) AS ab FROM marked WHERE stop AND next IS NOT NULL AND (short OR kind = '#') GROUP BY ALL),
pairs AS (SELECT * FROM (SELECT m.kind, m.next, {ratio_sql("x.n", "y.n", "ab", "every")} AS score FROM met m JOIN counts x ON x.kind = m.kind JOIN counts y ON y.kind = m.next ANTI JOIN starters s ON s.kind = m.next, total WHERE ab::DOUBLE / x.n > y.n / every) WHERE score >= 7.88)"""


@query(f"WITH {COUNTED} SELECT kind, stopped, plain, round(score, 6) + 0.0 AS score FROM scored")
def abbreviation_scores(t):
    found = splitting.abbreviations(cut(splitting.words(t.documents)))  # counted once, for the words and for their total
    return found.select("kind", "stopped", "plain", (F.round("score", 6) + 0.0).alias("score"))


@query(f"WITH {STARTED} SELECT kind, '' AS next, round(score, 6) AS score FROM starters UNION ALL SELECT kind, next, round(score, 6) FROM pairs")
def sentence_starters(t):
    """Words that begin sentences, and pairs that a stop does not part."""
    known = splitting.learned(t.documents)
    one = known.starters.select("kind", F.lit("").alias("next"), "score").unionByName(known.pairs)
    return one.select("kind", "next", F.round("score", 6).alias("score"))


@query(rf"""WITH {STARTED}, piece AS (SELECT doc_id, rid, unnest(l) AS piece, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, row_number() OVER () AS rid, {CUT} AS l FROM documents)),
words AS (SELECT *, {BARE.format(x="piece")} AS word, {BARE.format(x="lead(piece) OVER (PARTITION BY doc_id ORDER BY pos)")} AS after, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM piece),
kinds AS (SELECT *, {KIND.format(x="word")} AS kind, CASE WHEN after IS NOT NULL THEN {KIND.format(x="after")} END AS next FROM words),
ended AS (SELECT k.*, contains(piece, chr(10)) OR regexp_matches(word, '[!?]\z') OR (ends_with(word, '.') AND (NOT (s.kind IS NOT NULL OR ends_with(word, '..')) OR coalesce(regexp_matches(after, '^[A-Z]') AND b.kind IS NOT NULL AND p.kind IS NULL, false))) AS e
FROM kinds k LEFT JOIN short s ON s.kind = k.kind LEFT JOIN starters b ON b.kind = k.next LEFT JOIN pairs p ON p.kind = k.kind AND p.next = k.next),
numbered AS (SELECT *, coalesce(sum(e::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM ended)
SELECT doc_id, n::INT AS pos, min(off)::INT AS off, md5(string_agg(piece, '' ORDER BY pos)) AS digest FROM numbered GROUP BY doc_id, n""")
def trained_sentences(t):
    """Sentences by what the corpus says about its own stops."""
    found = splitting.split(t.documents, splitting.learned(t.documents))
    return found.select("doc_id", "pos", "off", F.md5("sent").alias("digest"))


# Tags.


def sentence_words(t: Tables) -> DataFrame:
    """(conv_id, turn, s, words, tags): the words of each sentence of a turn with their seed tags."""
    cut = t.conversations.select("conv_id", "turn", F.posexplode(F.split("text", r"[.!?\n]+")).alias("s", "said"))
    w = cut.select("conv_id", "turn", "s", F.regexp_extract_all("said", F.lit("[A-Za-z]+|[0-9]+"), F.lit(0)).alias("words"))
    return w.select("*", tagging.seeded(F.col("words")).alias("tags"))


def _seed_sql() -> str:
    listed = lambda x, t: f"lower({x}) IN ({', '.join(repr(w) for w in tagging.CLOSED[t].split())})"
    ends = lambda p, t: f"WHEN regexp_matches(lower(w), '{p}\\z') THEN '{t}'"
    return f"""CASE WHEN regexp_matches(w, '^[0-9]') THEN 'CD' {" ".join(f"WHEN {listed('w', t)} THEN '{t}'" for t in tagging.CLOSED)} WHEN b IS NOT NULL AND regexp_matches(w, '^[A-Z][a-z]') THEN 'NNP'
{ends("[a-z]{2}ing", "VBG")} {ends("[a-z]{2}ed", "VBD")} {ends("[a-z]{2}ly", "RB")} {ends("[a-z]{2}(ous|ful|ble|ive|al)", "JJ")} {ends("[a-z]{2}(tion|ment|ness|ity)", "NN")} {ends("[a-z]{3}[^s]s", "NNS")} WHEN {listed("b", "DT")} THEN 'NN' END"""


SEEDED = rf"""sn AS (SELECT conv_id, turn, unnest(l) AS said, generate_subscripts(l, 1) AS s FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[.!?\n]+') AS l FROM conversations)), tw AS (SELECT conv_id, turn, s, regexp_extract_all(said, '[A-Za-z]+|[0-9]+') AS ws FROM sn),
each AS (SELECT conv_id, turn, s, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w, unnest(list_prepend(NULL, ws[:-2])) AS b FROM tw WHERE len(ws) > 0), tagged AS (SELECT *, {_seed_sql()} AS tag FROM each),
sided AS (SELECT *, CASE WHEN pos = 1 THEN '^' ELSE lag(tag) OVER (PARTITION BY conv_id, turn, s ORDER BY pos) END AS before FROM tagged), told AS (SELECT CASE WHEN regexp_matches(w, '^[A-Z]') THEN left(w, 1) || lower(substr(w, 2)) ELSE lower(w) END AS word, tag, count(*) AS n FROM tagged WHERE tag IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {SEEDED} SELECT before, tag, count(*) AS n FROM sided WHERE before IS NOT NULL AND tag IS NOT NULL GROUP BY ALL")
def tag_transitions(t):
    return tagging.transitions(sentence_words(t))


@query(f"WITH {SEEDED} SELECT word, tag, n FROM told")
def tag_emissions(t):
    return tagging.emissions(sentence_words(t))


@query(f"WITH {SEEDED} SELECT CASE WHEN k = 0 THEN '' ELSE right(lower(word), k) END || CASE WHEN regexp_matches(word, '^[A-Z]') THEN 'A' ELSE 'a' END AS ending, tag, count(*) AS n FROM told, range(4) r(k) WHERE k <= length(word) GROUP BY ALL")
def tag_endings(t):
    return tagging.endings(tagging.emissions(sentence_words(t)))


def tagged(t: Tables) -> DataFrame:
    """(conv_id, turn, words, tags): the most probable tags of every word, sentence by sentence, by what the seed tags of all turns tell."""
    rows = sentence_words(t)
    told = tagging.emissions(rows)
    each = tagging.tag(rows.drop("tags"), tagging.model(tagging.transitions(rows), told, tagging.endings(told)))
    back = each.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("s", "words", "tags"))).alias("x"))
    flat = lambda c: F.flatten(F.transform("x", lambda x: x[c])).alias(c)
    return back.select("conv_id", "turn", flat("words"), flat("tags"))


@query()
def tagged_words(t):
    pairs = F.arrays_zip("words", "tags")
    return tagged(t).select("conv_id", "turn", F.posexplode(pairs).alias("pos", "x")).select("conv_id", "turn", "pos", F.col("x.words").alias("word"), F.col("x.tags").alias("tag"))


TAGS = ("CC", "CD", "DT", "IN", "JJ", "MD", "NN", "NNP", "NNS", "PRP", "RB", "TO", "VB", "VBD", "VBG")


@query()
def tag_counts(t):
    """A dense count for each tag, and the sums of the positive and of the negative polarities."""
    rows = tagged(t)
    count = lambda tag: F.size(F.filter("tags", lambda x: x == tag)).alias(f"tag_{tag.lower()}")
    sums = lexicon.scored(t.conversations, learned_lexicon(t), ("conv_id", "turn")).drop("words")
    return rows.select("conv_id", "turn", *map(count, TAGS)).join(sums, ["conv_id", "turn"])


@query()
def tag_slots(t):
    """The first ten tags of a turn with each word's polarity and subjectivity: empty and 0 where there is no such word."""
    rows = tagged(t).select("conv_id", "turn", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("slot"), "words", "tags")
    at = lambda c: F.coalesce(F.get(F.col(c), F.col("slot")), F.lit(""))
    slots = rows.select("conv_id", "turn", "slot", F.lower(at("words")).alias("word"), at("tags").alias("tag"))
    known = learned_lexicon(t).select("word", "polarity", "subjectivity")
    return slots.join(F.broadcast(known), "word", "left").select("conv_id", "turn", "slot", "tag", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("polarity", "subjectivity")))  # 20,000 words at most


# Words of script without spaces: turns without theirs stand in for it.

SQUEEZED = "squeezed AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^a-z]+', '', 'g') AS text FROM conversations)"
STRINGS = f"""{SQUEEZED}, run AS (SELECT chr(10) || text || chr(10) AS run FROM squeezed WHERE text <> ''), strings AS MATERIALIZED (SELECT substr(run, i, k) AS s, count(*) AS n FROM run, range(1, 6) r(k), unnest(range(1, length(run) - k + 2)) x(i) GROUP BY s)"""


def squeezed(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.regexp_replace(F.lower("text"), "[^a-z]+", "").alias("text"))


@query(f"""WITH {STRINGS}, inside AS (SELECT s, n FROM strings WHERE NOT contains(s, chr(10))), total AS (SELECT sum(n)::DOUBLE AS total FROM inside WHERE length(s) = 1), many AS (SELECT s, n FROM inside WHERE length(s) BETWEEN 2 AND 4 AND n >= 5),
halves AS (SELECT m.s, m.n, a.n AS na, b.n AS nb FROM (SELECT s, n, unnest(range(1, length(s))) AS k FROM many) m JOIN inside a ON a.s = left(m.s, k) JOIN inside b ON b.s = substr(m.s, k + 1)),
held AS (SELECT s, any_value(n) AS n, min(ln(n * total / (na::DOUBLE * nb))) AS cohesion FROM halves, total GROUP BY s),
edge AS (SELECT substr(s, 2) AS s, n, 0 AS side FROM strings WHERE length(s) BETWEEN 3 AND 5 AND NOT contains(substr(s, 2), chr(10)) UNION ALL SELECT left(s, -1), n, 1 FROM strings WHERE length(s) BETWEEN 3 AND 5 AND NOT contains(left(s, -1), chr(10))),
spread AS (SELECT s, side, sum(-n / every * ln(n / every)) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY s, side)::DOUBLE AS every FROM edge) GROUP BY s, side)
SELECT h.s AS word, n, round(cohesion, 6) AS cohesion, round(b.e, 6) AS before, round(a.e, 6) AS after FROM held h JOIN spread b ON b.s = h.s AND b.side = 0 JOIN spread a ON a.s = h.s AND a.side = 1""")
def word_candidates(t):
    """Strings that occur often, with how firmly they hold together and how freely they stand."""
    found = segmenting.candidates(segmenting.strings(segmenting.runs(squeezed(t), pattern="[a-z]+")))
    return found.select("word", "n", *(F.round(c, 6).alias(c) for c in ("cohesion", "before", "after")))


@query()
def segmented_words(t):
    """The most probable words of every turn without its spaces."""
    counts = segmenting.strings(segmenting.runs(squeezed(t), pattern="[a-z]+")).persist()
    known = segmenting.dictionary(counts, segmenting.candidates(counts), cohesion=0.5)  # 26 letters meet by chance more often than thousands
    counts.unpersist()
    rows = squeezed(t).select(F.struct("conv_id", "turn").alias("k"), "text")
    return segmenting.segmented(rows, known, "k", pattern="[a-z]+").select("k.conv_id", "k.turn", "off", "word")


# Polarities.

LABELLED = f"""{GOLD}, lt AS (SELECT y, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS ws FROM documents d JOIN gold g ON d.doc_id = g.doc_id WHERE y IS NOT NULL),
lw AS (SELECT word, count(*) AS n, count(*) FILTER (y = 1) AS neg, count(*) FILTER (y = 2) AS pos FROM (SELECT y, unnest(ws) AS word FROM lt) GROUP BY word HAVING count(*) >= 2 ORDER BY n DESC, word LIMIT 20000), la AS (SELECT count(*) FILTER (y = 1) AS an, count(*) FILTER (y = 2) AS ap FROM lt),
lex AS (SELECT word, n, round(tanh(CASE WHEN an > 0 AND ap > 0 THEN ln(((pos + ap / (an + ap)::DOUBLE) / (ap + 1.0)) / ((neg + an / (an + ap)::DOUBLE) / (an + 1.0))) ELSE 0 END * (neg + pos) / (neg + pos + 5.0) / 2), 6) AS polarity, round((neg + pos) / n::DOUBLE, 6) AS subjectivity FROM lw, la)"""


def learned_lexicon(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text").join(gold(t).where("y is not null").select("doc_id", "y"), "doc_id")
    return lexicon.polarities(lexicon.counted(rows), rows)


@query(f"WITH {LABELLED} SELECT word, n, polarity, subjectivity FROM lex")
def learned_polarities(t):
    return learned_lexicon(t)


_NEG = "[" + ", ".join(f"'{w}'" for w in lexicon.NEGATIONS) + "]"
_SCALE = "CASE ws[pos - 1] " + " ".join(f"WHEN '{w}' THEN {x}" for w, x in lexicon.SCALES.items()) + " ELSE 1.0 END"
SCOPED = rf"""{LABELLED}, st AS (SELECT conv_id, turn, unnest(l) AS s, generate_subscripts(l, 1) AS k FROM (SELECT conv_id, turn, regexp_split_to_array(lower(text), '[.!?\n]+') AS l FROM conversations)),
sw AS (SELECT conv_id, turn, k, regexp_extract_all(s, '[a-z]+') AS ws FROM st), sx AS (SELECT *, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM sw),
sp AS (SELECT x.*, polarity * CASE WHEN list_has_any(ws[greatest(pos - 3, 1):pos - 1], {_NEG}) THEN -1 ELSE 1 END * {_SCALE} AS p FROM sx x JOIN lex USING (word)),
ss AS (SELECT conv_id, turn, round(sum(greatest(p, 0)), 6) AS pos, round(sum(least(p, 0)), 6) AS neg, count(*) AS words FROM sp GROUP BY conv_id, turn),
scoped AS (SELECT c.conv_id, c.turn, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, coalesce(words, 0) AS words FROM conversations c LEFT JOIN ss ON ss.conv_id = c.conv_id AND ss.turn = c.turn)"""


@query(f"WITH {SCOPED} SELECT conv_id, turn, pos + 0.0 AS pos, neg + 0.0 AS neg, words FROM scoped")
def scoped_sentiment(t):
    """Signed sums of a turn by the learned lexicon, with negations and intensifiers in their scopes."""
    return lexicon.scored(t.conversations, learned_lexicon(t), ("conv_id", "turn"))


@query(f"WITH {SCOPED} SELECT conv_id, turn, CASE WHEN pos + neg > 0 THEN 2 ELSE 1 END AS y FROM scoped WHERE round(abs(pos + neg), 6) >= 0.1")
def scoped_filter(t):
    """Turns with an opinion, and which."""
    sums = lexicon.scored(t.conversations, learned_lexicon(t), ("conv_id", "turn"))
    total = F.col("pos") + F.col("neg")
    return sums.where(F.round(F.abs(total), 6) >= 0.1).select("conv_id", "turn", F.when(total > 0, 2).otherwise(1).alias("y"))
