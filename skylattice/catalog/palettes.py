"""Display palettes of the built-in products, lowest value first."""

from __future__ import annotations

# Ten colours per palette.
VEGETATION = (
    "#d73027", "#f46d43", "#fdae61", "#fee08b", "#ffffbf",
    "#d9ef8b", "#a6d96a", "#66bd63", "#1a9850", "#006837",
)
WATER = (
    "#a52a2a", "#d2691e", "#daa520", "#f0e68c", "#ffffbf",
    "#b0e0e6", "#87ceeb", "#4682b4", "#1e90ff", "#00008b",
)
METHANE = (
    "#313695", "#4575b4", "#74add1", "#abd9e9", "#e0f3f8",
    "#ffffbf", "#fee090", "#fdae61", "#f46d43", "#d73027",
)
BAND = (
    "#000004", "#1b0c41", "#4a0c6b", "#781c6d", "#a52c60",
    "#cf4446", "#ed6925", "#fb9b06", "#f7d13d", "#fcffa4",
)
FIRE = (
    "#006837", "#1a9850", "#66bd63", "#a6d96a", "#d9ef8b",
    "#fee08b", "#fdae61", "#f46d43", "#d73027", "#a50026",
)
SNOW = (
    "#8c510a", "#bf812d", "#dfc27d", "#f6e8c3", "#f5f5f5",
    "#c7eae5", "#80cdc1", "#35978f", "#01665e", "#003c30",
)
SOIL = (
    "#006837", "#1a9850", "#66bd63", "#a6d96a", "#d9ef8b",
    "#fee08b", "#dfc27d", "#bf812d", "#8c510a", "#543005",
)
URBAN = (
    "#1a9850", "#66bd63", "#a6d96a", "#d9ef8b", "#ffffbf",
    "#d9d9d9", "#bdbdbd", "#969696", "#636363", "#252525",
)
MINERAL = (
    "#2166ac", "#4393c3", "#92c5de", "#d1e5f0", "#ffffbf",
    "#fee08b", "#fdae61", "#f46d43", "#d73027", "#a50026",
)
TURBIDITY = (
    "#00008b", "#1e90ff", "#4682b4", "#87ceeb", "#b0e0e6",
    "#c8dbbe", "#a0a060", "#8b7d3c", "#6b4226", "#3d1c02",
)
WATER_QUALITY = (
    "#00008b", "#1e90ff", "#87ceeb", "#00cc66", "#66cc00",
    "#cccc00", "#ffaa00", "#ff6600", "#ff0000", "#990000",
)
BURN_CHANGE = (
    "#1a9850", "#66bd63", "#a6d96a", "#d9ef8b", "#ffffbf",
    "#fee08b", "#fdae61", "#f46d43", "#d73027", "#7a0177",
)
DIVERGING = (
    "#2166ac", "#4393c3", "#92c5de", "#d1e5f0", "#f7f7f7",
    "#fddbc7", "#f4a582", "#d6604d", "#b2182b", "#67001f",
)
NO2 = (
    "#ffffcc", "#ffeda0", "#fed976", "#feb24c", "#fd8d3c",
    "#fc4e2a", "#e31a1c", "#bd0026", "#800026", "#4d0013",
)
SO2 = (
    "#fff7f3", "#fde0dd", "#fcc5c0", "#fa9fb5", "#f768a1",
    "#dd3497", "#ae017e", "#7a0177", "#560060", "#340040",
)
CO = (
    "#000004", "#1b0c41", "#4a0c6b", "#781c6d", "#a52c60",
    "#cf4446", "#ed6925", "#fb9b06", "#f7d13d", "#fcffa4",
)
O3 = (
    "#1a0a5e", "#313695", "#4575b4", "#74add1", "#abd9e9",
    "#fee090", "#fdae61", "#f46d43", "#d73027", "#a50026",
)
CH4 = (
    "#440154", "#482878", "#3e4989", "#31688e", "#26828e",
    "#1f9e89", "#35b779", "#6ece58", "#b5de2b", "#fde725",
)
HCHO = (
    "#f7f4f9", "#e7e1ef", "#d4b9da", "#c994c7", "#df65b0",
    "#e7298a", "#ce1256", "#980043", "#67001f", "#3d000f",
)
RADAR_RATIO = (
    "#2166ac", "#4393c3", "#92c5de", "#d1e5f0", "#f7f7f7",
    "#fddbc7", "#f4a582", "#d6604d", "#b2182b", "#67001f",
)
PLUME = (
    "#0d0887", "#46039f", "#7201a8", "#9c179e", "#bd3786",
    "#d8576b", "#ed7953", "#fb9f3a", "#fdca26", "#f0f921",
)
