"""What a language looks like: its histograms in millionths, as fixed values.

Summed over the documents of sf0.1 with an even id, ``labels.quality`` 1 and the fixed limits of ``quality`` passed
(en 972, fr 234, de 247, es 155 documents). Character classes and words are in the order of ``quality``, other words last.
"""

from __future__ import annotations

# fmt: off
REFERENCES: dict[str, tuple[tuple[int, ...], tuple[int, ...]]] = {
    "en": (
        (795245, 13855, 552, 166652, 23663, 18, 15),
        (
            54509, 28573, 23095, 16674, 11618, 13539, 10734, 9266, 7698, 7875, 6561, 5726, 5264, 6849, 4802, 4792,
            4509, 2351, 3205, 3607, 4079, 4543, 0, 0, 7, 4, 0, 0, 4, 14, 0, 0,
            0, 2934, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
            0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 14, 0, 0, 0, 0, 0,
            0, 0, 0, 2586, 2, 0, 0, 0, 0, 0, 0, 0, 2, 0, 0, 0,
            0, 0, 0, 0, 754564,
        ),
    ),
    "fr": (
        (707863, 10360, 728, 166702, 23983, 33, 90331),
        (
            170, 100, 90, 40, 50, 30, 0, 20, 20, 30, 2211, 0, 10, 10, 10, 10,
            0, 0, 2821, 0, 10, 20, 0, 0, 21601, 30376, 14257, 9505, 6743, 55089, 8114, 11816,
            16858, 11546, 0, 5142, 4342, 6193, 6783, 5052, 6323, 0, 1921, 4312, 4272, 0, 4372, 3751,
            0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
            0, 0, 0, 40, 0, 0, 10, 0, 0, 10, 0, 0, 0, 0, 0, 0,
            0, 0, 0, 0, 755920,
        ),
    ),
    "de": (
        (772879, 12310, 419, 154659, 21787, 13, 37933),
        (
            116, 77, 19, 19, 16912, 19, 19, 9, 9, 19, 0, 0, 0, 19, 3143, 9,
            19, 0, 9, 9, 9, 9, 0, 0, 0, 0, 0, 0, 0, 9, 0, 6714,
            0, 3289, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1975, 0, 0, 0, 0,
            55973, 28327, 9205, 14372, 4495, 4563, 4612, 22868, 10013, 11687, 7580, 6218, 5760, 5284, 5040, 4524,
            7784, 3911, 77, 9, 9, 0, 0, 0, 0, 0, 0, 0, 9, 0, 0, 0,
            0, 0, 0, 0, 755249,
        ),
    ),
    "es": (
        (724393, 12011, 730, 161494, 23036, 13, 78323),
        (
            193, 48, 32, 80, 16, 32, 32, 16, 48, 32, 32, 16, 2998, 0, 0, 0,
            16, 0, 0, 0, 0, 16, 0, 0, 0, 29389, 0, 6964, 0, 54491, 16, 16,
            0, 13784, 0, 0, 16, 16, 22538, 0, 0, 0, 0, 0, 0, 0, 32, 0,
            16, 0, 0, 16, 0, 0, 0, 32, 0, 0, 16, 0, 0, 16, 0, 0,
            0, 0, 0, 4143, 16686, 10801, 8222, 5110, 7835, 11333, 6658, 4288, 5626, 5819, 8915, 4626,
            4465, 3579, 0, 0, 760929,
        ),
    ),
}
# fmt: on
