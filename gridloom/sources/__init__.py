"""File formats of the layers: GeoTIFF, GeoPackage, Shapefile, GeoJSON."""
