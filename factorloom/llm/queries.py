"""The queries of this subpackage and the SQL that gives the same rows."""

from . import decontamination, hmm, langid, linededup, mixing, ogg, pii, quality, simhash, warc

QUERIES = {
    "op1_ogg": ogg.op1_ogg,
    "op2_pii": pii.op2_pii,
    "op3_warc": warc.op3_warc,
    "op4_simhash": simhash.op4_simhash,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_quality": quality.op6_quality,
    "op7_linededup": linededup.op7_linededup,
    "op8_hmm": hmm.op8_hmm,
    "op9_mixing": mixing.op9_mixing,
    "op10_langid": langid.op10_langid,
}

ORACLE_SQL = {
    "op3_warc": warc.ORACLE,
    "op5_decontamination": decontamination.ORACLE,
    "op7_linededup": linededup.ORACLE,
    "op9_mixing": mixing.ORACLE,
}
