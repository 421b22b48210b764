"""What fitting an encoder to a dataset takes: settings, pairs and judgements. Fitting itself is left to the encoder."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import judgements
from .qa import training_pairs, warm_up_steps


@dataclass(frozen=True)
class TrainingConfig:
    """Settings of a fit and their defaults."""

    batch_size: int = 32
    epochs: int = 3
    learning_rate: float = 2e-5
    warmup_ratio: float = 0.1
    weight_decay: float = 0.01
    max_grad_norm: float = 1.0
    seed: int = 42

    def settings(self, n_pairs: int) -> dict:
        """All settings, the number of pairs, and the steps of warming up that follow from both."""
        return asdict(self) | {"num_pairs": n_pairs, "warmup_steps": warm_up_steps(n_pairs, batch=self.batch_size, epochs=self.epochs, ratio=self.warmup_ratio)}


def prepared_tables(examples: DataFrame, seed: int = 42) -> dict[str, DataFrame]:
    """pairs (question, context, place: their order in a fit, by a hash), queries, corpus and relevant of QA rows (id, doc_id, question, context)."""
    pairs = training_pairs(examples)
    placed = pairs.withColumn("place", F.sha2(F.concat_ws("|", "question", "context", F.lit(str(seed))), 256))
    queries, corpus, relevant = judgements(examples.withColumn("position", F.col("id")))
    return {"pairs": placed, "queries": queries, "corpus": corpus, "relevant": relevant}
