"""Quality classifier: a sparse ensemble of rules from trees, compiled to column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled rows that the model is fitted on, taken in the order of a hash of the id.
MOST_LABELLED = 20_000
TREES, DEPTH, BINS, PENALTY = 24, 3, 48, 2e-3
SPACE = r"[\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.split(t, "\n")
    n, count = F.char_length(t), F.size(words)
    share = lambda kept, of=n: F.when(of > 0, kept / of).otherwise(0.0)
    left = lambda pattern: F.char_length(F.regexp_replace(t, pattern, ""))
    return {
        "log_words": F.log1p(count.cast("double")),
        "word_chars": share(n, count),
        "distinct_words": share(F.size(F.array_distinct(words)), count),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "words_a_line": share(count, F.size(lines)),
        "upper": share(left(r"[^\p{Lu}]+")),
        "digits": share(left(r"[^\p{N}]+")),
        "symbols": share(left(r"[\p{L}\p{N}\s.,;:'\"!?()-]+")),
        "exclaims": share(left(r"[^!?]+")),
        "stops": share(left(r"[^.,;:]+")),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, bound): above means greater than bound, else at most bound."""

    conditions: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(x[s] > b) == above for s, above, b in self.conditions])

    def column(self, stats: dict[str, Column]) -> Column:
        parts = [stats[s] > b if above else stats[s] <= b for s, above, b in self.conditions]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    """Score = logistic(bias + sum of the weights of the rules that hold)."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats: dict[str, Column]) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(stats), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def tree_paths(x: np.ndarray, names: list[str], target: np.ndarray, curve: np.ndarray, depth: int, bounds: list[np.ndarray]) -> tuple[list[Rule], np.ndarray]:
    """The paths from the root to every node of one tree that fits target / curve by Newton steps, and the tree's values per row."""
    rules: list[Rule] = []
    value = np.zeros(len(target))

    def grow(rows: np.ndarray, path: tuple, level: int) -> None:
        g, h = target[rows].sum(), curve[rows].sum()
        value[rows] = g / (h + 1.0)
        if level == depth or len(rows) < 20:
            return
        best = (1e-9, -1, 0.0)
        for j in range(len(names)):
            at = np.searchsorted(bounds[j], x[rows, j], side="left")
            gs = np.cumsum(np.bincount(at, target[rows], len(bounds[j]) + 1))[:-1]
            hs = np.cumsum(np.bincount(at, curve[rows], len(bounds[j]) + 1))[:-1]
            ns = np.cumsum(np.bincount(at, minlength=len(bounds[j]) + 1))[:-1]
            gain = np.where((ns >= 10) & (len(rows) - ns >= 10), gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), 0)
            k = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[k] > best[0]:
                best = (float(gain[k]), j, float(bounds[j][k]))
        if best[1] < 0:
            return
        _, j, b = best
        for above in (False, True):
            step = (*path, (names[j], above, b))
            rules.append(Rule(tuple(sorted(step))))
            grow(rows[(x[rows, j] > b) == above], step, level + 1)

    grow(np.arange(len(target)), (), 0)
    return rules, value


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights that minimise the mean logistic loss plus penalty times the weights' absolute sum, by accelerated proximal steps."""
    n, k = r.shape
    size = 0.25 * np.linalg.norm(np.c_[r, np.ones(n)], 2) ** 2 / n
    w = z = np.zeros(k + 1)
    w[-1] = z[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    full, t = np.c_[r, np.ones(n)], 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ z, -30, 30)))
        new = z - full.T @ (p - y) / n / size
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - penalty / size, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[-1]), w[:-1]


def fit(x: dict[str, np.ndarray], y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleEnsemble:
    """Boosts small trees, takes the paths to all their nodes as rules, and keeps those that the lasso gives a weight.

    Without rows of both classes there are no rules, and the bias is the share of label 1 with one row of each class added.
    """
    n, positive = len(y), float(y.sum())
    if n == 0 or positive in (0.0, float(n)):
        share = (positive + 1) / (n + 2)
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    names = sorted(x)
    table = np.column_stack([x[s] for s in names])
    bounds = [np.unique(np.quantile(table[:, j], np.linspace(0.01, 0.99, BINS))) for j in range(len(names))]
    total, found = np.full(n, np.log(positive / (n - positive))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        rules, value = tree_paths(table, names, y - p, p * (1 - p), depth, bounds)
        found += rules
        total = total + 0.3 * np.clip(value, -4, 4)
    distinct = list(dict.fromkeys(found))
    holds = np.column_stack([r.holds(x) for r in distinct]).astype(float) if distinct else np.zeros((n, 0))
    bias, weights = lasso_logistic(holds, y, penalty)
    return RuleEnsemble(bias, tuple((r, float(w)) for r, w in zip(distinct, weights) if abs(w) > 1e-6))


def is_held_out(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(id_col.cast("string")) % folds == 0


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> RuleEnsemble:
    """Fits on at most ``most`` labelled rows outside the held-out fold; of repeated labels the largest counts, null ones are dropped. Of documents that share a labelled id the one with the least statistics, in their order, is fitted on, so what is collected is bounded too."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    found = texts.join(F.broadcast(known), "doc_id")  # at most ``most`` rows of two numbers
    stats = statistics(F.col("text"))
    one = found.select("doc_id", "y", F.struct(*[c.alias(s) for s, c in stats.items()]).alias("s_")).groupBy("doc_id", "y").agg(F.min("s_").alias("s_"))
    rows = one.select("doc_id", "y", "s_.*").toPandas().sort_values(["doc_id", *stats], kind="stable")
    return fit({s: rows[s].to_numpy(float) for s in stats}, (rows["y"].to_numpy(float) > 0).astype(float))


def score_documents(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row: doc_id, held_out, score, predicted.

    Empty and null texts are scored too, by the statistics of an empty text; a null id is never held out. Ids, language,
    source and labels are no inputs. Repeated rows each get a row; other columns are ignored; an empty table gives an empty result.
    """
    stats = statistics(F.col("text"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", *[c.alias(s) for s, c in stats.items()])
    rows = rows.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), model.score({s: F.col(s) for s in stats}).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores threshold or more."""
    stats = {f"_{s}_stat": c for s, c in statistics(F.col(text_col).cast("string")).items()}
    # A filter is not moved below a projection that numbers rows; if it were, each rule would compute its statistics anew.
    kept = docs.select(F.struct("*").alias("row_"), F.monotonically_increasing_id().alias("number_"), *[c.alias(s) for s, c in stats.items()])
    kept = kept.where((model.score({s: F.col(f"_{s}_stat") for s in statistics(F.lit(""))}) >= threshold) & (F.col("number_") >= 0))
    return kept.select("row_.*")
