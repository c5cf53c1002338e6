"""isobarn.operators"""
