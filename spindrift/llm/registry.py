"""The queries of the training-data operators and the SQL of those that SQL can express."""

from . import op10_sentencepiece as op10
from . import op1_quality as op1
from . import op2_fingerprints as op2
from . import op3_warc as op3
from . import op4_ngram_join as op4
from . import op5_token_counts as op5
from . import op6_chat_formatting as op6
from . import op7_decontamination as op7
from . import op8_language as op8
from . import op9_url_filters as op9

QUERIES = {
    "op1_quality": op1.op1_quality,
    "op2_fingerprints": op2.op2_fingerprints,
    "op3_warc": op3.op3_warc,
    "op4_ngram_join": op4.op4_ngram_join,
    "op5_token_counts": op5.op5_token_counts,
    "op6_chat_formatting": op6.op6_chat_formatting,
    "op7_decontamination": op7.op7_decontamination,
    "op8_language": op8.op8_language,
    "op9_url_filters": op9.op9_url_filters,
    "op10_sentencepiece": op10.op10_sentencepiece,
}

ORACLE_SQL = {
    "op3_warc": op3.ORACLE_SQL,
    "op4_ngram_join": op4.ORACLE_SQL,
    "op6_chat_formatting": op6.ORACLE_SQL,
    "op7_decontamination": op7.ORACLE_SQL,
    "op9_url_filters": op9.ORACLE_SQL,
}
