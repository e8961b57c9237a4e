"""Colours of communities and fields."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hue in degrees of each research field.
FIELD_HUES = {
    "Medicine": 0.0,
    "Social Sciences": 96.9,
    "Engineering": 193.8,
    "Biochemistry, Genetics and Molecular Biology": 290.8,
    "Physics and Astronomy": 27.7,
    "Agricultural and Biological Sciences": 124.6,
    "Computer Science": 221.5,
    "Environmental Science": 318.5,
    "Materials Science": 55.4,
    "Arts and Humanities": 152.3,
    "Chemistry": 249.2,
    "Earth and Planetary Sciences": 346.2,
    "Neuroscience": 83.1,
    "Psychology": 180.0,
    "Economics, Econometrics and Finance": 276.9,
    "Business, Management and Accounting": 13.8,
    "Health Professions": 110.8,
    "Immunology and Microbiology": 207.7,
    "Mathematics": 304.6,
    "Energy": 41.5,
    "Decision Sciences": 138.5,
    "Dentistry": 235.4,
    "Nursing": 332.3,
    "Pharmacology, Toxicology and Pharmaceutics": 69.2,
    "Chemical Engineering": 166.2,
    "Veterinary": 263.1,
}
# The constants of the 64-bit mixing function.
MIX_STEP, MIX_FIRST, MIX_SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
RGB = T.StructType([T.StructField(c, T.DoubleType()) for c in "rgb"])


def mixed_bits(numbers: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each number (wrap-around arithmetic)."""
    z = numbers.astype(np.int64).view(np.uint64) + np.uint64(MIX_STEP)
    for shift, factor in ((30, MIX_FIRST), (27, MIX_SECOND)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def jitter(bits: np.ndarray, part: int) -> np.ndarray:
    """The part-th 16 bits, spread over [-1, 1]."""
    return ((bits >> np.uint64(16 * part)) & np.uint64(0xFFFF)).astype(float) / 0xFFFF * 2 - 1


def rgb_of(hue: np.ndarray, light: np.ndarray, saturation: np.ndarray) -> pd.DataFrame:
    """Hue in degrees, lightness and saturation to red, green and blue in 0..1."""
    spread = saturation * np.minimum(light, 1 - light)

    def channel(n: int) -> np.ndarray:
        k = (n + hue / 30) % 12
        return light - spread * np.maximum(-1, np.minimum(np.minimum(k - 3, 9 - k), 1))

    return pd.DataFrame({"r": channel(0), "g": channel(8), "b": channel(4)})


@F.pandas_udf(RGB)
def community_color(community: pd.Series, members: pd.Series, cx: pd.Series, cy: pd.Series, least: pd.Series) -> pd.DataFrame:
    """Large communities: hue from the angle of their centroid around the centre of the
    map, so that neighbours have near hues. Others (fewer members than least): dim grey."""
    bits = mixed_bits(community.to_numpy())
    j1, j2, j3 = (jitter(bits, i) for i in range(3))
    hue = (np.degrees(np.arctan2(cy.to_numpy() - 0.5, cx.to_numpy() - 0.5)) + 8 * j1) % 360
    small = (members < least).to_numpy()
    return rgb_of(np.where(small, 0.0, hue), np.where(small, 0.30 + 0.06 * j1, 0.58 + 0.08 * j3), np.where(small, 0.03, 0.70 + 0.08 * j2))


@F.pandas_udf(RGB)
def field_color(hue: pd.Series, community: pd.Series) -> pd.DataFrame:
    """The older palette: a field's hue with a small wobble by community; grey for null."""
    bits = mixed_bits(community.to_numpy())
    j1, j2 = jitter(bits, 0), jitter(bits, 1)
    grey = hue.isna().to_numpy()
    wobbled = (hue.fillna(0).to_numpy() + 9 * j1) % 360
    saturation, light = np.clip(0.90 + 0.10 * j2, 0.80, 1.0), np.clip(0.48 + 0.08 * j2, 0.40, 0.58)
    return rgb_of(np.where(grey, 0.0, wobbled), np.where(grey, 0.62 + 0.18 * j1, light), np.where(grey, 0.03, saturation))
