"""almanac: PySpark operators for collections of historical texts, calendars and the sky."""
