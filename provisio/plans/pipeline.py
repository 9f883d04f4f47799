"""The retrieval pipeline: flags decide which plan is built."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provisio.operators import bm25, dense, fusion, lookup
from provisio.operators.embed import Embedder, embedded


@dataclass(frozen=True)
class PipelineConfig:
    use_dense: bool = True
    use_sparse: bool = False
    use_citation_lookup: bool = True
    use_rerank: bool = False
    k_retrieve: int = 20
    k_final: int = 5
    order_by_authority: bool = False
    filter_tax_year: bool = False

    @property
    def pool(self) -> int:
        """More candidates only where something narrows them again."""
        return self.k_retrieve if self.use_rerank or (self.use_dense and self.use_sparse) else self.k_final


#: The configurations that evaluations compare.
ABLATION = {
    "dense_only": PipelineConfig(use_dense=True, use_sparse=False),
    "bm25_only": PipelineConfig(use_dense=False, use_sparse=True),
    "hybrid": PipelineConfig(use_dense=True, use_sparse=True),
}


def retrieve(questions: DataFrame, chunks: DataFrame, config: PipelineConfig, *, vectors: DataFrame | None = None, embedder: Embedder | None = None, index: bm25.Index | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank, retriever): the ``k_final`` rows of each (query_id, question[, tax_year]).

    Dense retrieval needs ``vectors`` (chunk_id, embedding) and the ``embedder`` they come from.
    """
    if not (config.use_dense or config.use_sparse):
        raise ValueError("at least one of use_dense and use_sparse is needed")
    lists = []
    if config.use_dense:
        if vectors is None or embedder is None:
            raise ValueError("dense retrieval needs vectors and an embedder")
        asked = embedded(questions.select("query_id", "question"), embedder, text_col="question", is_query=True)
        lists.append(dense.top_k(vectors, asked, config.pool, dim=embedder.dim, id_col="chunk_id", vec_col="embedding"))
    if config.use_sparse:
        lists.append(bm25.top_k(index or bm25.build(chunks), questions, config.pool))
    ranked = fusion.reciprocal_rank_fusion(lists) if len(lists) == 2 else lists[0]
    if config.filter_tax_year:
        ranked = fusion.in_force(ranked, chunks, questions)
    if config.order_by_authority:
        ranked = fusion.by_authority(ranked, chunks).drop("authority_weight")
    if config.use_citation_lookup:
        return fusion.prioritise(lookup.lookup(questions, chunks), ranked, k=config.k_final)
    return ranked.filter(F.col("rank") <= config.k_final)
