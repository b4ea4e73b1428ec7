"""Plain dynamic programmes that the LCS kernels are held against."""

import numpy as np


def lcs_length_dp(a, b) -> int:
    """Length of the longest common subsequence."""
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            cur[j] = prev[j - 1] + 1 if x == y else max(cur[j - 1], prev[j])
        prev = cur
    return prev[-1]


def lcs_indices_table(ref_codes, cand_codes) -> list:
    """Indices of ref tokens on one LCS path from a full DP table."""
    ref_codes, cand_codes = np.asarray(ref_codes), np.asarray(cand_codes)
    m, n = len(ref_codes), len(cand_codes)
    if m == 0 or n == 0:
        return []
    table = np.zeros((m + 1, n + 1), dtype=np.int32)
    for i in range(1, m + 1):
        eq = (cand_codes == ref_codes[i - 1]).astype(np.int32)
        old = table[i - 1]
        c = np.maximum(old[1:], old[:-1] + eq)
        table[i, 1:] = np.maximum.accumulate(c)
    out = []
    i, j = m, n
    while i > 0 and j > 0:
        if ref_codes[i - 1] == cand_codes[j - 1]:
            out.append(i - 1)
            i -= 1
            j -= 1
        elif table[i, j - 1] > table[i - 1, j]:
            j -= 1
        else:
            i -= 1
    return out
