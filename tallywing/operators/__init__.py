"""DataFrame to DataFrame steps on the count panel ``(species, date, year, birds, effort, weather, observer)``."""
