from reviewlab.functions.scores import argmax_label, binarise, positive_score, softmax
from reviewlab.functions.student import fixed, paired_p_ten_runs, t_pvalue
from reviewlab.functions.text import cap_tokens, clean_label, clean_text, strip_unicode

__all__ = [
    "argmax_label",
    "binarise",
    "cap_tokens",
    "clean_label",
    "clean_text",
    "fixed",
    "paired_p_ten_runs",
    "positive_score",
    "softmax",
    "strip_unicode",
    "t_pvalue",
]
