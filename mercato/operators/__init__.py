"""Cleaning, the fact build and the named analytics.

Every operator is a pure ``DataFrame -> DataFrame`` function over built-in
expressions; nothing here collects data to the driver.
"""
