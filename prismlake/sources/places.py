"""Places with coordinates, for place-name search and reverse geocoding without a network."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "city string, region string, country string, country_code string, lat double, lon double, radius_deg double"

# fixed values: city, region, country, country code, latitude, longitude, half the side of its box in degrees
PLACES = [
    ("San Francisco", "California", "United States", "US", 37.7749, -122.4194, 0.6),
    ("Los Angeles", "California", "United States", "US", 34.0522, -118.2437, 0.8),
    ("San Diego", "California", "United States", "US", 32.7157, -117.1611, 0.5),
    ("San Jose", "California", "United States", "US", 37.3382, -121.8863, 0.45),
    ("Yosemite Valley", "California", "United States", "US", 37.7456, -119.5936, 0.5),
    ("Seattle", "Washington", "United States", "US", 47.6062, -122.3321, 0.6),
    ("Portland", "Oregon", "United States", "US", 45.5152, -122.6784, 0.5),
    ("Las Vegas", "Nevada", "United States", "US", 36.1699, -115.1398, 0.5),
    ("Phoenix", "Arizona", "United States", "US", 33.4484, -112.074, 0.6),
    ("Denver", "Colorado", "United States", "US", 39.7392, -104.9903, 0.6),
    ("Austin", "Texas", "United States", "US", 30.2672, -97.7431, 0.5),
    ("Dallas", "Texas", "United States", "US", 32.7767, -96.797, 0.6),
    ("Houston", "Texas", "United States", "US", 29.7604, -95.3698, 0.6),
    ("Chicago", "Illinois", "United States", "US", 41.8781, -87.6298, 0.6),
    ("New York", "New York", "United States", "US", 40.7128, -74.006, 0.7),
    ("Boston", "Massachusetts", "United States", "US", 42.3601, -71.0589, 0.5),
    ("Washington", "D.C.", "United States", "US", 38.9072, -77.0369, 0.5),
    ("Miami", "Florida", "United States", "US", 25.7617, -80.1918, 0.6),
    ("Orlando", "Florida", "United States", "US", 28.5383, -81.3792, 0.5),
    ("Honolulu", "Hawaii", "United States", "US", 21.3069, -157.8583, 0.6),
    ("Toronto", "Ontario", "Canada", "CA", 43.6532, -79.3832, 0.6),
    ("Vancouver", "British Columbia", "Canada", "CA", 49.2827, -123.1207, 0.6),
    ("Montreal", "Quebec", "Canada", "CA", 45.5017, -73.5673, 0.6),
    ("Mexico City", "CDMX", "Mexico", "MX", 19.4326, -99.1332, 0.7),
    ("Cancun", "Quintana Roo", "Mexico", "MX", 21.1619, -86.8515, 0.6),
    ("San Luis", "San Luis", "Argentina", "AR", -33.3017, -66.3378, 0.8),
    ("Potrero de los Funes", "San Luis", "Argentina", "AR", -33.2208, -66.2281, 0.35),
    ("Villa de Merlo", "San Luis", "Argentina", "AR", -32.3429, -65.0139, 0.45),
    ("Villa Mercedes", "San Luis", "Argentina", "AR", -33.6757, -65.4578, 0.45),
    ("Buenos Aires", "CABA", "Argentina", "AR", -34.6037, -58.3816, 0.8),
    ("Cordoba", "Cordoba", "Argentina", "AR", -31.4201, -64.1888, 0.7),
    ("Mendoza", "Mendoza", "Argentina", "AR", -32.8895, -68.8458, 0.7),
    ("Rosario", "Santa Fe", "Argentina", "AR", -32.9442, -60.6505, 0.5),
    ("San Carlos de Bariloche", "Rio Negro", "Argentina", "AR", -41.1335, -71.3103, 0.7),
    ("Salta", "Salta", "Argentina", "AR", -24.7821, -65.4232, 0.6),
    ("Ushuaia", "Tierra del Fuego", "Argentina", "AR", -54.8019, -68.303, 0.6),
    ("Santiago", "Metropolitana", "Chile", "CL", -33.4489, -70.6693, 0.7),
    ("Sao Paulo", "SP", "Brazil", "BR", -23.5505, -46.6333, 0.8),
    ("Rio de Janeiro", "RJ", "Brazil", "BR", -22.9068, -43.1729, 0.7),
    ("Lima", "Lima", "Peru", "PE", -12.0464, -77.0428, 0.7),
    ("Cusco", "Cusco", "Peru", "PE", -13.532, -71.9675, 0.6),
    ("Bogota", "Cundinamarca", "Colombia", "CO", 4.711, -74.0721, 0.7),
    ("Montevideo", "Montevideo", "Uruguay", "UY", -34.9011, -56.1645, 0.6),
    ("London", "England", "United Kingdom", "GB", 51.5074, -0.1278, 0.7),
    ("Edinburgh", "Scotland", "United Kingdom", "GB", 55.9533, -3.1883, 0.5),
    ("Paris", "Ile-de-France", "France", "FR", 48.8566, 2.3522, 0.7),
    ("Nice", "Provence-Alpes-Cote d'Azur", "France", "FR", 43.7102, 7.262, 0.5),
    ("Lyon", "Auvergne-Rhone-Alpes", "France", "FR", 45.764, 4.8357, 0.5),
    ("Madrid", "Madrid", "Spain", "ES", 40.4168, -3.7038, 0.7),
    ("Barcelona", "Catalonia", "Spain", "ES", 41.3851, 2.1734, 0.6),
    ("Seville", "Andalusia", "Spain", "ES", 37.3891, -5.9845, 0.5),
    ("Valencia", "Valencia", "Spain", "ES", 39.4699, -0.3763, 0.5),
    ("Lisbon", "Lisbon", "Portugal", "PT", 38.7223, -9.1393, 0.6),
    ("Porto", "Porto", "Portugal", "PT", 41.1579, -8.6291, 0.5),
    ("Rome", "Lazio", "Italy", "IT", 41.9028, 12.4964, 0.7),
    ("Milan", "Lombardy", "Italy", "IT", 45.4642, 9.19, 0.6),
    ("Florence", "Tuscany", "Italy", "IT", 43.7696, 11.2558, 0.5),
    ("Venice", "Veneto", "Italy", "IT", 45.4408, 12.3155, 0.5),
    ("Naples", "Campania", "Italy", "IT", 40.8518, 14.2681, 0.5),
    ("Berlin", "Berlin", "Germany", "DE", 52.52, 13.405, 0.7),
    ("Munich", "Bavaria", "Germany", "DE", 48.1351, 11.582, 0.6),
    ("Frankfurt", "Hesse", "Germany", "DE", 50.1109, 8.6821, 0.5),
    ("Hamburg", "Hamburg", "Germany", "DE", 53.5511, 9.9937, 0.5),
    ("Amsterdam", "North Holland", "Netherlands", "NL", 52.3676, 4.9041, 0.5),
    ("Brussels", "Brussels", "Belgium", "BE", 50.8503, 4.3517, 0.5),
    ("Zurich", "Zurich", "Switzerland", "CH", 47.3769, 8.5417, 0.5),
    ("Geneva", "Geneva", "Switzerland", "CH", 46.2044, 6.1432, 0.5),
    ("Vienna", "Vienna", "Austria", "AT", 48.2082, 16.3738, 0.6),
    ("Prague", "Prague", "Czechia", "CZ", 50.0755, 14.4378, 0.5),
    ("Warsaw", "Masovia", "Poland", "PL", 52.2297, 21.0122, 0.6),
    ("Budapest", "Budapest", "Hungary", "HU", 47.4979, 19.0402, 0.6),
    ("Athens", "Attica", "Greece", "GR", 37.9838, 23.7275, 0.6),
    ("Stockholm", "Stockholm", "Sweden", "SE", 59.3293, 18.0686, 0.6),
    ("Copenhagen", "Capital", "Denmark", "DK", 55.6761, 12.5683, 0.5),
    ("Oslo", "Oslo", "Norway", "NO", 59.9139, 10.7522, 0.5),
    ("Dublin", "Leinster", "Ireland", "IE", 53.3498, -6.2603, 0.5),
    ("Istanbul", "Marmara", "Turkey", "TR", 41.0082, 28.9784, 0.7),
    ("Tokyo", "Kanto", "Japan", "JP", 35.6762, 139.6503, 0.8),
    ("Kyoto", "Kansai", "Japan", "JP", 35.0116, 135.7681, 0.5),
    ("Osaka", "Kansai", "Japan", "JP", 34.6937, 135.5023, 0.6),
    ("Seoul", "Seoul", "South Korea", "KR", 37.5665, 126.978, 0.7),
    ("Taipei", "Taiwan", "Taiwan", "TW", 25.033, 121.5654, 0.6),
    ("Hong Kong", "Hong Kong", "Hong Kong", "HK", 22.3193, 114.1694, 0.5),
    ("Singapore", "Singapore", "Singapore", "SG", 1.3521, 103.8198, 0.5),
    ("Bangkok", "Bangkok", "Thailand", "TH", 13.7563, 100.5018, 0.7),
    ("Bali", "Bali", "Indonesia", "ID", -8.4095, 115.1889, 0.7),
    ("Dubai", "Dubai", "United Arab Emirates", "AE", 25.2048, 55.2708, 0.6),
    ("Mumbai", "Maharashtra", "India", "IN", 19.076, 72.8777, 0.7),
    ("New Delhi", "Delhi", "India", "IN", 28.6139, 77.209, 0.7),
    ("Beijing", "Beijing", "China", "CN", 39.9042, 116.4074, 0.8),
    ("Shanghai", "Shanghai", "China", "CN", 31.2304, 121.4737, 0.8),
    ("Sydney", "New South Wales", "Australia", "AU", -33.8688, 151.2093, 0.7),
    ("Melbourne", "Victoria", "Australia", "AU", -37.8136, 144.9631, 0.7),
    ("Auckland", "Auckland", "New Zealand", "NZ", -36.8485, 174.7633, 0.6),
    ("Queenstown", "Otago", "New Zealand", "NZ", -45.0312, 168.6626, 0.6),
    ("Cape Town", "Western Cape", "South Africa", "ZA", -33.9249, 18.4241, 0.6),
    ("Cairo", "Cairo", "Egypt", "EG", 30.0444, 31.2357, 0.7),
    ("Marrakesh", "Marrakesh-Safi", "Morocco", "MA", 31.6295, -7.9811, 0.6),
]


#: Sides of the cells of the cover, in degrees.
CELL_DEG = 2


def in_order() -> list[tuple]:
    """The places by city, country and latitude."""
    return sorted(PLACES, key=lambda p: (p[0], p[2], p[4]))


@lru_cache
def cover() -> list[list[int]]:
    """For each cell of CELL_DEG degrees, from the south and in rows from the west, the places (as in in_order()) that can be the nearest one of a point in it.

    From a cell's middle a point is at most a radius away, so a place that is more than two of them farther from the middle than the
    nearest place is can't be nearest.
    """
    lat, lon = np.meshgrid(np.arange(-90, 90, CELL_DEG), np.arange(-180, 180, CELL_DEG), indexing="ij")
    lat, lon = np.radians(lat.reshape(-1, 1) + CELL_DEG / 2), np.radians(lon.reshape(-1, 1) + CELL_DEG / 2)
    half = np.radians(CELL_DEG / 2)

    def away(lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
        a = np.sin((lat2 - lat) / 2) ** 2 + np.cos(lat) * np.cos(lat2) * np.sin((lon2 - lon) / 2) ** 2
        return 2 * np.arcsin(np.sqrt(np.clip(a, 0, 1)))

    # the farthest points of a cell are its corners
    radius = np.maximum(away(lat - half, lon - half), away(lat + half, lon - half)) * 1.001 + 1e-6
    places = in_order()
    far = away(np.radians([[p[4] for p in places]]), np.radians([[p[5] for p in places]]))
    can = far <= far.min(axis=1, keepdims=True) + 2 * radius
    return [np.flatnonzero(row).tolist() for row in can]


def gazetteer(spark: SparkSession) -> DataFrame:
    """One row a place; the table is PLACES, so it is always small enough to broadcast."""
    return spark.createDataFrame(PLACES, SCHEMA)


def oracle_rows() -> str:
    """The same table as a VALUES list with column names."""
    quoted = lambda v: repr(v) if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({', '.join(map(quoted, p))})" for p in PLACES)
    return f"(values {rows}) as places(city, region, country, country_code, lat, lon, radius_deg)"
