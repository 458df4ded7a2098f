"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import dac, decontaminate, htmltext, language, neardup, packing, pii, secretscan, urlfilter, vafile

QUERIES = {
    f.__name__: f
    for f in (
        dac.op1_token_codes, vafile.op2_va_file_top_k, packing.op3_best_fit_packing, language.op4_language_id, decontaminate.op5_winnowing, pii.op6_semi_markov_pii,
        neardup.op7_circulant_minhash, secretscan.op8_grammar_secrets, urlfilter.op9_redirect_equivalence, htmltext.op10_maximum_subsequence,
    )
}
ORACLE_SQL = {"op2_va_file_top_k": vafile.SQL, "op5_winnowing": decontaminate.SQL, "op7_circulant_minhash": neardup.SQL, "op9_redirect_equivalence": urlfilter.SQL}
