"""The queries of this subpackage by name, and their SQL where it can express them."""

from __future__ import annotations

from .audio_fingerprint import op1_audio_fingerprint
from .centroid_clusters import OP12_SQL, op12_orchard_clusters
from .decontaminate import OP7_SQL, op7_decontaminate
from .fill_in_middle import OP11_SQL, op11_fill_in_middle
from .jaccard_join import op4_jaccard_join
from .language_id import op5_language_id
from .license_scan import op3_license_scan
from .packing import op9_packing
from .quality_fm import op2_quality_fm
from .sharding import op10_sharding
from .source_mix import OP13_SQL, op13_source_mix
from .toxicity_chain import op8_toxicity
from .training_order import op6_training_order

QUERIES = (
    op1_audio_fingerprint,
    op2_quality_fm,
    op3_license_scan,
    op4_jaccard_join,
    op5_language_id,
    op6_training_order,
    op7_decontaminate,
    op8_toxicity,
    op9_packing,
    op10_sharding,
    op11_fill_in_middle,
    op12_orchard_clusters,
    op13_source_mix,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op7_decontaminate": OP7_SQL, "op11_fill_in_middle": OP11_SQL, "op12_orchard_clusters": OP12_SQL, "op13_source_mix": OP13_SQL}
