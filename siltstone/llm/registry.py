"""The queries opN_<name> of the training-data operators and the DuckDB SQL of those that SQL can express."""

from .compaction import OP2_SQL, op2_compaction
from .jaccard import OP8_SQL, op8_jaccard
from .langid import op7_langid
from .matroska import op4_matroska
from .mixing import OP6_SQL, op6_mixing
from .packing import op10_packing
from .quality import op9_quality
from .secrets import op5_secrets
from .sstable import op1_sstable
from .topk import OP3_SQL, op3_topk

QUERIES: dict = {
    "op1_sstable": op1_sstable,
    "op2_compaction": op2_compaction,
    "op3_topk": op3_topk,
    "op4_matroska": op4_matroska,
    "op5_secrets": op5_secrets,
    "op6_mixing": op6_mixing,
    "op7_langid": op7_langid,
    "op8_jaccard": op8_jaccard,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
}
ORACLES: dict = {"op2_compaction": OP2_SQL, "op3_topk": OP3_SQL, "op6_mixing": OP6_SQL, "op8_jaccard": OP8_SQL}
