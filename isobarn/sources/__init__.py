"""isobarn.sources"""
