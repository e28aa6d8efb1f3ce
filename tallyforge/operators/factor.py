"""Factor models over sparse counts: user steps and model steps as joins and sums; small mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.arrays import dot, total


def mixture_loglik(x: Column, means: list[float], sd: float) -> Column:
    """Log of an even mixture of unnormalised Gaussian bumps."""
    s = sum((F.exp(-(x - m) * (x - m) / (2 * sd * sd)) for m in means), F.lit(0.0))
    return F.ln(s / float(len(means)))


def array_sum(column: str, n: int) -> Column:
    """Element-wise sum of arrays of n numbers, for use in an aggregate."""
    return F.array(*[F.sum(F.get(column, F.lit(i))) for i in range(n)])


def scaled(k: Column, a: Column) -> Column:
    return F.transform(a, lambda x: k * x)


def start_users(triples: DataFrame, k: int, value: float = 1.0) -> DataFrame:
    return triples.select("doc").distinct().withColumn("u", F.array(*[F.lit(float(value))] * k))


#: Terms up to which a model of a few numbers a term is sent to every task (some 20 MB); more are joined by shuffle.
SENT_TERMS = 250_000


def with_model(triples: DataFrame, model: DataFrame, k: int) -> DataFrame:
    """triples joined with their terms' factors; the model is broadcast only after it was counted."""
    return triples.join(F.broadcast(model) if model.count() * max(k, 4) <= SENT_TERMS * 4 else model, "term")


def lda_user_step(triples: DataFrame, users: DataFrame, model: DataFrame, k: int, alpha: float, floor: float = 1e-10, expectation=None) -> DataFrame:
    """(doc, u): u * (M (S / (M'u))) + alpha for counts (doc, term, s), model (term, m): one join of the triples with
    both factors and one sum by document. `expectation`, if given, is applied to each element (exp of digamma)."""
    j = with_model(triples, model, k).join(users, "doc")
    r = j.withColumn("q", F.col("s") / F.greatest(dot(F.col("u"), F.col("m")), F.lit(floor)))
    g = r.select("doc", scaled(F.col("q"), F.col("m")).alias("qm")).groupBy("doc").agg(array_sum("qm", k).alias("g"))
    new = F.zip_with("u", "g", lambda u, x: u * x + alpha)
    return users.join(g, "doc").select("doc", (F.transform(new, expectation) if expectation else new).alias("u"))


def lda_model_step(triples: DataFrame, users: DataFrame, model: DataFrame, k: int, beta: float, floor: float = 1e-10) -> DataFrame:
    """(term, m): m * (sum over documents of u s / (M'u)) + beta."""
    j = with_model(triples, model, k).join(users, "doc")
    r = j.withColumn("q", F.col("s") / F.greatest(dot(F.col("u"), F.col("m")), F.lit(floor)))
    g = r.select("term", scaled(F.col("q"), F.col("u")).alias("qu")).groupBy("term").agg(array_sum("qu", k).alias("g"))
    return model.join(g, "term").select("term", F.zip_with("m", "g", lambda m, x: m * x + beta).alias("m"))


def lda_loglik(triples: DataFrame, users: DataFrame, model: DataFrame, k: int) -> DataFrame:
    """(ll): mean log probability of a token under each document's mixture of normalised topics."""
    tot = model.agg(array_sum("m", k).alias("mt"))
    m = model.crossJoin(F.broadcast(tot)).select("term", F.zip_with("m", "mt", lambda a, b: a / b).alias("m"))
    u = users.select("doc", F.transform("u", lambda x: x / total(F.col("u"))).alias("u"))
    j = triples.join(u, "doc").join(m, "term")
    return j.agg((F.sum(F.col("s") * F.ln(dot(F.col("u"), F.col("m")))) / F.sum("s")).alias("ll"))


def nmf_user_step(triples: DataFrame, users: DataFrame, model: DataFrame, gram: list[list[float]], prior: float, low: float = 0.1, high: float = 10.0) -> DataFrame:
    """(doc, u): u * clamp(M S / ((M M' + prior I) u)); gram is M M', k by k numbers from one aggregate."""
    k = len(gram)
    g = with_model(triples, model, k).select("doc", scaled(F.col("s"), F.col("m")).alias("sm")).groupBy("doc").agg(array_sum("sm", k).alias("g"))
    den = [total(F.zip_with(F.array(*[F.lit(float(v + (prior if i == j else 0.0))) for j, v in enumerate(row)]), "u", lambda a, b: a * b)) for i, row in enumerate(gram)]
    new = F.array(*[F.get("u", F.lit(i)) * F.greatest(F.lit(low), F.least(F.lit(high), F.get("g", F.lit(i)) / den[i])) for i in range(k)])
    return users.join(g, "doc").select("doc", new.alias("u"))


def poisson_score(views: DataFrame, clicks: DataFrame, users: DataFrame, model: DataFrame) -> DataFrame:
    """(score): mean over viewed cells of c ln(r) - r, with rate r = views times (u.m)."""
    j = views.join(clicks, ["doc", "term"], "left").join(users, "doc").join(model, "term")
    r = F.greatest(F.col("v") * dot(F.col("u"), F.col("m")), F.lit(1e-10))
    return j.agg(F.avg(F.coalesce("c", F.lit(0)) * F.ln(r) - r).alias("score"))


def baselines(ratings: DataFrame, damp: float) -> DataFrame:
    """Adds mean, item and user offsets (damped) of ratings (user, item, rating)."""
    mean = ratings.agg(F.avg("rating").alias("mean"))
    r = ratings.crossJoin(F.broadcast(mean))
    items = r.groupBy("item").agg((F.sum(F.col("rating") - F.col("mean")) / (F.count("*") + damp)).alias("item_off"))
    r = r.join(items, "item")
    users = r.groupBy("user").agg((F.sum(F.col("rating") - F.col("mean") - F.col("item_off")) / (F.count("*") + damp)).alias("user_off"))
    return r.join(users, "user")


def topic_cosines(model: DataFrame) -> DataFrame:
    """(t1, t2, cos), t1 < t2, of topic rows (topic, feature, w): a feature meets each of the few topics once."""
    n = model.groupBy("topic").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    m = model.join(F.broadcast(n), "topic").select("feature", "topic", (F.col("w") / F.col("n")).alias("w"))
    a = m.select("feature", F.col("topic").alias("t1"), F.col("w").alias("a"))
    b = m.select("feature", F.col("topic").alias("t2"), F.col("w").alias("b"))
    return a.join(b, "feature").where("t1 < t2").groupBy("t1", "t2").agg(F.sum(F.col("a") * F.col("b")).alias("cos"))


def langevin_step(ratings: DataFrame, own: DataFrame, other: DataFrame, key: str, k: int, rate: float, noise: float) -> DataFrame:
    """(key, u, kept, loss): each owner's factors after one proposal along the slope of their own ratings, with noise, that is
    taken with probability exp(old loss - new loss). ratings: (key, other's key, y); own: (key, u); other: (its key, m).
    Draws come from the owner's key, so that a task run again draws the same."""
    from tallyforge.functions import sampling

    j = ratings.join(own, key).join(other, [c for c in other.columns if c != "m"]).withColumn("r", F.col("y") - dot(F.col("u"), F.col("m")))
    slope = j.withColumn("rm", scaled(F.col("r"), F.col("m"))).groupBy(key).agg(F.array(*[F.avg(F.get("rm", F.lit(i))) for i in range(k)]).alias("g"))
    new = F.array(*[F.get("u", F.lit(i)) + 2 * rate * F.get("g", F.lit(i)) + noise * sampling.normal(F.col(key), i) for i in range(k)])
    proposed = own.join(slope, key).select(key, "u", new.alias("v"))
    both = ratings.join(proposed, key).join(other, [c for c in other.columns if c != "m"])
    square = lambda c: F.avg(F.pow(F.col("y") - dot(F.col(c), F.col("m")), F.lit(2.0)))
    judged = both.groupBy(key).agg(square("u").alias("old"), square("v").alias("new"))
    kept = F.ln(sampling.uniform(F.col(key), 2 * k + 1)) < F.col("old") - F.col("new")
    return proposed.join(judged, key).select(key, F.when(kept, F.col("v")).otherwise(F.col("u")).alias("u"), kept.alias("kept"), F.when(kept, F.col("new")).otherwise(F.col("old")).alias("loss"))


def mixture_posterior(x: Column, means: list[float], sd: float, which: int) -> Column:
    """Probability that x comes from one of evenly mixed Gaussian bumps."""
    return F.exp(-(x - means[which]) * (x - means[which]) / (2 * sd * sd)) / sum((F.exp(-(x - m) * (x - m) / (2 * sd * sd)) for m in means), F.lit(0.0))


def gibbs_counts(triples: DataFrame, users: DataFrame, model: DataFrame, k: int, samples: Column | None = None, cooling: float = 1.0) -> DataFrame:
    """(doc, n): how many tokens of a document draw each topic, every token one (or `samples` many), with chances that
    go with (u m) to the power 1 / cooling. Draws come from the document, the term and the token's number; nothing is gathered:
    a cell's draws are counted inside its row and added up by document."""
    from tallyforge.functions import sampling

    j = with_model(triples, model, k).join(users, "doc")
    p = F.zip_with("u", "m", lambda a, b: F.pow(a * b, F.lit(1.0 / cooling)))
    j = j.withColumn("p", p).withColumn("z", total(F.col("p")))
    upto = [total(F.slice("p", 1, i + 1)) / F.col("z") for i in range(k - 1)]
    key = F.col("doc") * 7919 + F.ascii("term") * 131 + F.length("term") * 17
    tokens = F.sequence(F.lit(0), (F.col("s") * (samples if samples is not None else F.lit(1))).cast("int") - 1)
    j = j.withColumn("upto", F.array(*upto)).withColumn("drawn", F.transform(tokens, lambda i: F.size(F.filter("upto", lambda c: sampling.uniform(key, i) > c))))
    hits = lambda t: F.size(F.filter("drawn", lambda x: x == t))
    counts = F.array(*[hits(t) for t in range(k)])
    return j.select("doc", counts.alias("c")).groupBy("doc").agg(array_sum("c", k).alias("n"))
