"""The registered query of each corpus operator, with SQL where SQL can express it."""

from __future__ import annotations

from quern.llm.bpe_transducer import op9_bpe_transducer
from quern.llm import decontamination, license_scan, metric_search
from quern.llm.decontamination import op2_decontamination
from quern.llm.language_id import op10_language_id
from quern.llm.license_scan import op6_license_scan
from quern.llm.lm_scoring import op4_lm_scoring
from quern.llm.metric_search import op5_metric_search
from quern.llm.ngram_join import op3_ngram_jaccard_join
from quern.llm.quality_ranking import op8_quality_ranking
from quern.llm.suffix_dedup import op1_suffix_dedup
from quern.llm.token_counts import op7_token_counts

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_metric_search": op5_metric_search,
    "op6_license_scan": op6_license_scan,
    "op7_token_counts": op7_token_counts,
    "op8_quality_ranking": op8_quality_ranking,
    "op9_bpe_transducer": op9_bpe_transducer,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": decontamination.ORACLE_SQL,
    "op5_metric_search": metric_search.ORACLE_SQL,
    "op6_license_scan": license_scan.ORACLE_SQL,
}
