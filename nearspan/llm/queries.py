"""Queries of this subpackage and, where SQL can say the same, their DuckDB statements."""

from __future__ import annotations

from nearspan.llm.ann import op3_nearest_neighbours
from nearspan.llm.embedding_join import OP1_SQL, op1_embedding_dedup
from nearspan.llm.fm_dedup import OP9_SQL, op9_substring_dedup
from nearspan.llm.kd_shard import op5_kd_sharding
from nearspan.llm.mixing import OP4_SQL, op4_mixing
from nearspan.llm.packing import op10_packing
from nearspan.llm.quality import op7_quality
from nearspan.llm.secrets import op2_secret_scan
from nearspan.llm.simhash import op8_simhash
from nearspan.llm.toxicity import op6_toxicity

QUERIES = {"op1_embedding_dedup": op1_embedding_dedup, "op2_secret_scan": op2_secret_scan, "op3_nearest_neighbours": op3_nearest_neighbours, "op4_mixing": op4_mixing, "op5_kd_sharding": op5_kd_sharding, "op6_toxicity": op6_toxicity, "op7_quality": op7_quality, "op8_simhash": op8_simhash, "op9_substring_dedup": op9_substring_dedup, "op10_packing": op10_packing}

ORACLES: dict[str, str] = {"op1_embedding_dedup": OP1_SQL, "op4_mixing": OP4_SQL, "op9_substring_dedup": OP9_SQL}
