"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from quillstone.llm import embedding_dedup, exponion, metric_tree, ngram_join, warc
from quillstone.llm.embedding_dedup import op7_embedding_near_dedup
from quillstone.llm.exponion import op11_exponion_clusters
from quillstone.llm.language_id import op3_language_id
from quillstone.llm.line_dedup import op8_line_dedup
from quillstone.llm.media import op9_mpeg_media
from quillstone.llm.metric_tree import op13_metric_tree_top_k
from quillstone.llm.mixing import op10_source_mixing
from quillstone.llm.ngram_join import op1_ngram_jaccard_join
from quillstone.llm.packing import op4_packing
from quillstone.llm.token_alignment import op12_token_alignment
from quillstone.llm.token_counts import op2_token_counts
from quillstone.llm.token_files import op6_token_id_files
from quillstone.llm.warc import op5_warc_packages


def queries() -> dict:
    return {"op1_ngram_jaccard_join": op1_ngram_jaccard_join, "op2_token_counts": op2_token_counts, "op3_language_id": op3_language_id, "op4_packing": op4_packing, "op5_warc_packages": op5_warc_packages, "op6_token_id_files": op6_token_id_files, "op7_embedding_near_dedup": op7_embedding_near_dedup, "op8_line_dedup": op8_line_dedup, "op9_mpeg_media": op9_mpeg_media, "op10_source_mixing": op10_source_mixing, "op11_exponion_clusters": op11_exponion_clusters, "op12_token_alignment": op12_token_alignment, "op13_metric_tree_top_k": op13_metric_tree_top_k}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": ngram_join.SQL, "op5_warc_packages": warc.SQL, "op7_embedding_near_dedup": embedding_dedup.SQL, "op11_exponion_clusters": exponion.SQL, "op13_metric_tree_top_k": metric_tree.SQL}
