"""barline.sources"""
