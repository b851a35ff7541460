"""Summaries by term frequency (X2): the sentences whose words are frequent in a corpus.

After SumBasic (Nenkova & Vanderwende 2005): a sentence scores the mean weight
of its words, the weight of a word being its share of the corpus.  The best
sentence is taken, the weights of its words are squared (they have been said),
and the next one is chosen.  Weights are whole billionths, so scores do not
depend on the order of summation; of equal scores the earlier sentence goes first.

The term table is as large as the corpus has words and is joined: words that
make up a thousandth of the corpus or more are at most a thousand and go to
every task, the others are met by a shuffle in which no word is frequent.  The
choice among the sentences of a text is an expression over an array that the
prompt's token budget bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import payload_of
from ..functions.text import sentences, strip
from .embed import WORD
from .infer import Backend

#: The weight of a word that is the whole corpus.
WHOLE = 1_000_000_000
#: A word of this share of the corpus or more is joined by broadcast: there are at most as many as the inverse.
FREQUENT = 1 / 1000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def term_weights(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, weight): every word's share of all words of a corpus, in billionths, rounded down."""
    counts = texts.select(F.explode(words_of(F.col(text_col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.select("word", F.floor(F.col("n") / total.scalar() * WHOLE).cast("long").alias("weight"))


def _with_weights(words: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds the weight of every word (0 if the corpus lacks it)."""
    often = terms.where(F.col("weight") >= int(WHOLE * FREQUENT)).select("word", F.col("weight").alias("_often"))
    rare = terms.where(F.col("weight") < int(WHOLE * FREQUENT)).select("word", F.col("weight").alias("_rare"))
    out = words.join(F.broadcast(often), "word", "left")
    known = out.where(F.col("_often").isNotNull()).withColumn("_rare", F.lit(None).cast("long"))
    # The terms are unique, so the build side is small; the texts' words stream past and are not sorted.
    others = out.where(F.col("_often").isNull()).join(rare.hint("shuffle_hash"), "word", "left")
    return known.unionByName(others).withColumn("weight", F.coalesce("_often", "_rare", F.lit(0))).drop("_often", "_rare")


#: Sentences chosen one after another: places in ``found``, with the words' weights after each choice.
_CHOICE = """aggregate(sequence(1, {k}), named_struct('taken', cast(array() as array<int>), 'w', weights), (st, round) ->
  transform(array(array_max(transform(found, (x, i) ->
      if(array_contains(st.taken, i), null, struct(aggregate(x.words, 0L, (a, y) -> a + st.w[y]) div size(x.words) as score, -i as i))))),
    best -> if(best is null, st, named_struct('taken', array_append(st.taken, -best.i),
      'w', transform(st.w, (v, j) -> if(exists(found[-best.i].words, y -> y = j), v * v div {whole}, v)))))[0],
  st -> transform(st.taken, i -> found[i].s))"""


def _cut(df: DataFrame, array: str, field: str, begins: str) -> DataFrame:
    """Adds the places (from 1) where a run of one ``field`` begins in a sorted array of structs."""
    return df.withColumn(begins, F.expr(f"""if(size({array}) > 0,
        filter(sequence(1, size({array})), i -> i = 1 or {array}[i - 1].{field} <> {array}[greatest(i - 2, 0)].{field}), cast(array() as array<int>))"""))


def _run(array: str, begins: str) -> str:
    """The run that begins at place b, the j-th."""
    return f"slice({array}, b, coalesce(get({begins}, j + 1), size({array}) + 1) - b)"


def choose_sentences(texts: DataFrame, terms: DataFrame, k: int, key: str = "prompt_id", text_col: str = "text") -> DataFrame:
    """(key, chosen): places (from 0) of the ``k`` sentences of each text, in the order of choice; texts without words are left out.

    ``key`` tells the texts apart.
    """
    said = F.flatten(F.transform(sentences(F.col(text_col)), lambda p, s: F.transform(words_of(p), lambda w: F.struct(w.alias("word"), s.alias("s")))))
    # One row for a word of a text, made within the text: neither grouping nor sorting of rows, of which a few compressed MB make very many.
    runs = _cut(texts.select(key, F.sort_array(said).alias("said")), "said", "word", "begins")
    words = runs.select(key, F.posexplode(F.expr(f"transform(begins, (b, j) -> struct(said[b - 1].word as word, transform({_run('said', 'begins')}, x -> x.s) as at))")).alias("id", "run"))
    weighed = _with_weights(words.select(key, "id", "run.word", "run.at"), terms).select(key, "id", "weight", "at").repartition(key)
    by_text = weighed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("id", "weight", "at"))).alias("met"))
    spread = F.expr("sort_array(flatten(transform(met, (x, i) -> transform(x.at, s -> struct(s as s, i as id)))))")
    listed = _cut(by_text.select(key, F.expr("transform(met, x -> x.weight)").alias("weights"), spread.alias("spread")), "spread", "s", "begins")
    found = F.expr(f"transform(begins, (b, j) -> struct(spread[b - 1].s as s, transform({_run('spread', 'begins')}, y -> y.id) as words))")
    return listed.select(key, "weights", found.alias("found")).select(key, F.expr(_CHOICE.format(k=k, whole=WHOLE)).alias("chosen"))


class FreqBackend(Backend):
    """Deterministic model: the ``k`` sentences of the payload that a corpus' term weights favour, in text order;
    the whole payload when it has no sentence with a word."""

    def __init__(self, terms: DataFrame, k: int = 2):
        self.terms = terms
        self.k = k
        self.name = f"freq{k}"

    def frame(self, prompts: DataFrame) -> DataFrame:
        texts = prompts.select("prompt_id", payload_of(F.col("prompt")).alias("text"))
        chosen = choose_sentences(texts, self.terms, self.k)
        kept = F.array_join(F.filter(sentences(F.col("text")), lambda x, i: F.array_contains("chosen", i)), "")
        told = F.when(F.col("chosen").isNull(), F.col("text")).otherwise(kept)
        return texts.join(chosen, "prompt_id", "left").select("prompt_id", strip(told).alias("response"))
