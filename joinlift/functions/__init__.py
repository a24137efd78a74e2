from joinlift.functions.exprs import (  # noqa: F401
    finite, hash32, max_modulus, order_of_magnitude, pearson, unbiased_kurtosis, unbiased_skewness,
)
from joinlift.functions.spread import (  # noqa: F401
    attach, average_ranks, cumulate, deal, group_median, hash_order, materialise, meet, positions, shared_dir, with_one_row,
)
