"""Quality classifier: a sparse ensemble of rules, compiled into Spark column expressions.

Statistics of a text are built-in column expressions over the whole text. On a bounded sample of labelled
documents (rows_per_class of each class, by least hash of the id) boosted shallow trees are grown; each path
from a root to a node becomes a conjunctive rule over the statistics; an L1-penalised logistic model, its
penalty chosen on a fifth of the sample, keeps few rules; those are compiled into one column expression,
so scoring all documents is a projection inside Spark without Python.

Defined cases: a null text counts as empty, and empty texts get the score of their statistics (all zero); a
null id is never held out nor learned from; without labels of both classes every score is the share of
label 1 (0.5 without any); repeated rows are scored alike; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.llm.common import WORD
from usagelake.llm.labelled import remainder, sampled_ids

ROWS_PER_CLASS = 4000


def statistics(text: Column) -> dict[str, Column]:
    """Name to expression; shares are of characters, words or lines, and 0 where there are none."""
    t = F.coalesce(text, F.lit(""))
    chars, words, lines, sentences = F.length(t), F.regexp_count(t, F.lit(WORD)), F.split(t, "\n"), F.split(t, r"[.!?]+\s*")
    per = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")
    kept = lambda other: F.length(F.regexp_replace(t, other, ""))
    found = lambda mark: chars - F.length(F.replace(t, F.lit(mark), F.lit("")))
    tokens = F.split(F.lower(t), r"[\x20\x09-\x0D]+")
    return {
        "log_words": F.log1p(words.cast("double")),
        "word_length": per(chars, words),
        "upper": per(kept(r"[^\p{Lu}]+"), chars),
        "digits": per(kept(r"[^0-9]+"), chars),
        "symbols": per(kept(r"[\p{L}\p{N}\s.,]+"), chars),
        "stops": per(kept(r"[^.,]+"), words),
        "bangs": per(found("!"), words),
        "pipes": per(found("|"), words),
        "hashes": per(kept(r"[^#$%&*@^~]+"), words),
        "braces": per(kept(r"[^{}<>\[\]=;_/\\]+"), words),
        "breaks": per(F.size(lines) - 1, words),
        "distinct_lines": per(F.size(F.array_distinct(lines)), F.size(lines)),
        "distinct_sentences": per(F.size(F.array_distinct(sentences)), F.size(sentences)),
        "distinct_words": per(F.size(F.array_distinct(tokens)), F.size(tokens)),
        "long_words": per(F.size(F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]{25,}"), F.lit(0))), words),
    }


Rule = tuple[tuple[int, float, bool], ...]  # (statistic, threshold, above) of each condition


def rule_holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    held = np.ones(len(x), bool)
    for k, threshold, above in rule:
        held &= (x[:, k] > threshold) == above
    return held


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, bins: int, rng: np.random.Generator) -> list[Rule]:
    """Paths of boosted trees on half samples; each split has the greatest Newton gain over quantile thresholds."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k]) for k, c in enumerate(cuts)], 1)
    margin, rules = np.zeros(len(x)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p) + 1e-6
        drawn = rng.random(len(x)) < 0.5
        features = rng.choice(x.shape[1], max(2, x.shape[1] * 2 // 3), replace=False)
        work: list[tuple[np.ndarray, Rule]] = [(np.ones(len(x), bool), ())]
        while work:
            here, path = work.pop()
            fit = here & drawn
            if len(path) < depth and fit.sum() >= 20:
                best, (g, h) = (1e-3, -1, 0), (grad[fit].sum(), hess[fit].sum())
                for k in features:
                    gl = np.cumsum(np.bincount(binned[fit, k], grad[fit], len(cuts[k]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[fit, k], hess[fit], len(cuts[k]) + 1))[:-1]
                    if gl.size:
                        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                        at = int(np.argmax(gain))
                        best = max(best, (float(gain[at]), int(k), at))
                if best[1] >= 0:
                    _, k, at = best
                    above = binned[:, k] > at
                    for side in (False, True):
                        rules.append((*path, (k, float(cuts[k][at]), side)))
                        work.append((here & (above == side), rules[-1]))
                    continue
            if fit.any():
                margin[here] += 0.3 * grad[fit].sum() / (hess[fit].sum() + 1)
    return list(dict.fromkeys(rules))


def lasso_logistic(a: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient; the intercept isn't penalised."""
    n, step = weight.sum(), 4.0 / max(1e-9, float((a * a * weight[:, None]).sum(0).max() / weight.sum()) * min(a.shape[1], 40) + 1)
    w, b = np.zeros(a.shape[1]), 0.0
    w0, b0, t = w, b, 1.0
    for _ in range(rounds):
        r = (1 / (1 + np.exp(-(a @ w0 + b0))) - y) * weight / n
        moved = w0 - step * (a.T @ r)
        w1, b1 = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0), b0 - step * r.sum()
        t1 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w0, b0 = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return w, b


@dataclass
class RuleModel:
    names: list[str]
    rules: list[Rule]
    weights: list[float]
    bias: float

    def score(self, columns: dict[str, Column]) -> Column:
        """The model as one column expression: a sum of weights of the rules that hold, through the logistic."""
        margin = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for k, threshold, above in rule:
                c = columns[self.names[k]]
                holds = holds & (c > threshold if above else c <= threshold)
            margin = margin + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            margin += weight * rule_holds(rule, x)
        return 1 / (1 + np.exp(-margin))


def fit_rules(names: list[str], x: np.ndarray, y: np.ndarray, share: float | None = None, trees: int = 60, depth: int = 3, bins: int = 32, seed: int = 0) -> RuleModel:
    """share: of label 1 in the population, where the sample has another one."""
    if len(y) == 0 or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return RuleModel(names, [], [], float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    share = y.mean() if share is None else share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    rules = [r for r in grow_rules(x, y, trees, depth, bins, rng) if 0.002 < rule_holds(r, x).mean() < 0.998]
    a = np.stack([rule_holds(r, x) for r in rules], 1).astype(np.float64) if rules else np.zeros((len(x), 0))
    if rules:
        _, first = np.unique(a.astype(np.uint8), axis=1, return_index=True)
        rules, a = [rules[i] for i in sorted(first)], a[:, sorted(first)]
    check = rng.random(len(x)) < 0.2
    best = (np.inf, 1e-3)
    for penalty in (1e-2, 3e-3, 1e-3, 3e-4):
        w, b = lasso_logistic(a[~check], y[~check], weight[~check], penalty, 200)
        z = a[check] @ w + b
        loss = float((weight[check] * (np.logaddexp(0, z) - y[check] * z)).sum() / max(1e-9, weight[check].sum()))
        best = min(best, (loss, penalty))
    w, b = lasso_logistic(a, y, weight, best[1])
    kept = np.flatnonzero(np.abs(w) > 1e-3)
    return RuleModel(names, [rules[i] for i in kept], [float(w[i]) for i in kept], float(b))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held: int = 2, rows_per_class: int = ROWS_PER_CLASS) -> RuleModel:
    columns = statistics(F.col("text"))
    names = list(columns)
    # At most 2 * rows_per_class ids and one row of statistics for each: bounded whatever the tables' sizes.
    ids = sampled_ids(labels, label, modulus, held, rows_per_class).toPandas()
    if ids.empty:
        return fit_rules(names, np.zeros((0, len(names))), np.zeros(0))
    counts = {int(r["label"]): r["n"] for r in labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), modulus) != held)).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).collect()}
    picked = F.broadcast(docs.sparkSession.createDataFrame(ids))
    sample = docs.select("doc_id", "text").join(picked, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "label", *[c.alias(n) for n, c in columns.items()]).toPandas().sort_values("doc_id")
    return fit_rules(names, sample[names].to_numpy(float), sample["label"].to_numpy(float), counts.get(1, 0) / max(1, sum(counts.values())))


def score_quality(docs: DataFrame, model: RuleModel, modulus: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    columns = statistics(F.col("text"))
    used = {model.names[k] for rule in model.rules for k, _, _ in rule}
    rows = docs.select("doc_id", *[c.alias(f"_{n}") for n, c in columns.items() if n in used])
    rows = rows.withColumn("score", model.score({n: F.col(f"_{n}") for n in used}))
    return rows.select("doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
