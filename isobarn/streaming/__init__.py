"""isobarn.streaming"""
